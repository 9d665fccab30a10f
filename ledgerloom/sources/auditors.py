"""The auditor that a filing is signed by, from the lines of its document, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import province, stripped
from .filings import repaired

# fixed values: patterns of auditors' lines
SUFFIX = r"(?:회\s*계\s*법\s*인|감\s*사\s*반)(?![가-힣])"
SIGNER = r"대표\s*이사|대표자|공인\s*회계사|사원"
NOT_AUDITOR = r"담당|임원|위원회"
LONGEST_LINE = 40
LINES_ABOVE = 6
_SPELLINGS = "|".join(sorted((s for all_ in fixed.PROVINCES.values() for s in all_), key=len, reverse=True))


def texts(documents: DataFrame, number: str = "rcept_no", content: str = "content") -> DataFrame:
    """(rcept_no, text): documents with their encodings repaired; a broken one has a null text."""

    def one(raw):
        try:
            return repaired(raw) if raw is not None else None
        except Exception:  # one broken document must not end the job
            return None

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rcept_no": pdf[number], "text": pdf[content].map(one)})

    return documents.select(number, content).mapInPandas(run, "rcept_no string, text string")


def lines_of(text: Column) -> Column:
    """Text lines between tags, blanks folded, empty ones left out."""
    broken = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "\n"), "&cr;", "\n")
    return F.filter(F.transform(F.split(broken, "\n"), lambda x: stripped(F.regexp_replace(x, r"[ \t ]+", " "))), lambda x: x != "")


def auditor_name(line: Column) -> Column:
    """The name in a line: the Korean letters up to the suffix, and a name that follows it up to a signer."""
    head = F.regexp_extract(line, rf"^(.*?)(?:{SUFFIX})", 1)
    suffix = F.regexp_replace(F.regexp_extract(line, rf"({SUFFIX})", 1), r"\s+", "")
    before = F.regexp_extract(head, r"([가-힣\s]*)$", 1)
    # a number's unit right before the name belongs to an address
    behind_digit = F.regexp_extract(head, r"(\d)[가-힣\s]*$", 1) != ""
    before = F.when(behind_digit, F.regexp_replace(before, r"^(?:[층호]|번지(?=\s))", "")).otherwise(before)
    after = F.regexp_extract(line, rf"^.*?(?:{SUFFIX})(.*)$", 1)
    after = F.regexp_replace(after, rf"(?:{SIGNER}).*$", "")
    tail = F.regexp_replace(F.regexp_extract(after, r"^([가-힣\s]*)", 1), r"\s+", "")
    name = F.concat(F.regexp_replace(before, r"\s+", ""), suffix, F.when(tail != "", F.concat(F.lit(" "), tail)).otherwise(F.lit("")))
    return F.nullif(F.trim(F.regexp_replace(name, r"\(.*$", "")), F.lit(""))


def office_address(line: Column) -> Column:
    """An address with the standard name of its province in front."""
    words = F.split(stripped(line), r"\s+")
    first = F.get(words, F.lit(0))
    return F.concat_ws(" ", F.coalesce(province(first), first), F.concat_ws(" ", F.slice(words, 2, 100)))


def auditors(documents: DataFrame) -> DataFrame:
    """(rcept_no, auditor_name, auditor_address): the last candidate with an address, else the first one.

    A candidate is a short line with an auditor's suffix; its address stands in front of the
    name or in one of the lines above, where the province may have a line of its own.
    """
    lines = texts(documents).select("rcept_no", lines_of(F.col("text")).alias("lines"))
    each = lines.select("rcept_no", "lines", F.posexplode("lines").alias("i", "line"))
    fits = (F.length("line") <= LONGEST_LINE) & F.col("line").rlike(SUFFIX) & ~F.col("line").rlike(NOT_AUDITOR)
    found = each.where(fits).withColumn("name", auditor_name(F.col("line"))).where("name is not null")
    start = rf"^(?:{_SPELLINGS})\s"
    own = stripped(F.regexp_extract("line", rf"^(.*?)(?:{SUFFIX})", 1))
    above = F.reverse(F.slice("lines", F.greatest(F.col("i") - LINES_ABOVE + 1, F.lit(1)), F.least(F.col("i"), F.lit(LINES_ABOVE))))
    below = F.concat(F.array(F.col("line")), above)  # the line that follows each of those above
    joined = F.transform(above, lambda x, k: F.when(x.rlike(start), x).when(x.rlike(rf"^(?:{_SPELLINGS})$"), F.concat_ws(" ", x, F.get(below, k))))
    address = F.when(own.rlike(start), own).otherwise(F.get(F.filter(joined, lambda x: x.isNotNull()), F.lit(0)))
    found = found.withColumn("address", F.when(F.col("i") > 0, address).otherwise(F.when(own.rlike(start), own)))
    found = found.withColumn("address", F.when(F.col("address").isNotNull(), office_address(F.col("address"))))
    # with an address the last counts, without one the first
    rank = F.struct(F.col("address").isNotNull(), F.when(F.col("address").isNotNull(), F.col("i")).otherwise(-F.col("i")))
    best = found.groupBy("rcept_no").agg(F.max_by(F.struct("name", "address"), rank).alias("a"))
    return lines.select("rcept_no").join(best, "rcept_no", "left").select("rcept_no", F.col("a.name").alias("auditor_name"), F.col("a.address").alias("auditor_address"))


def shown(name: Column, address: Column) -> Column:
    """``name(province district)``, or the name alone."""
    region = F.array_join(F.slice(F.split(F.coalesce(address, F.lit("")), r"\s+"), 1, 2), " ")
    return F.when(F.coalesce(name, F.lit("")) != "", F.when(F.trim(region) != "", F.concat(name, F.lit("("), region, F.lit(")"))).otherwise(name))
