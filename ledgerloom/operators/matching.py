"""Matching company rows: by position, by repair of swapped rows, by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import address_parts, company_name, corporate_number, names_align
from .ordering import materialised, ranked_within
from .predicates import in_region

ALLOWED_SHARE = 0.30
ALLOWED_ROWS = 3


def positional_join(sheet: DataFrame, listed: DataFrame, unit: str = "unit", position: str = "position") -> tuple[DataFrame, DataFrame]:
    """Join two ordered lists of each unit row by row; units that don't line up are rejected whole.

    ``sheet`` has corp_name, ``listed`` corp_code and listed_name. Returns the joined rows of
    accepted units and one row per unit (n_sheet, n_listed, n_mismatched, accepted).
    """
    both = sheet.withColumn("_in_sheet", F.lit(1)).join(listed.withColumn("_in_list", F.lit(1)), [unit, position], "full")
    aligned = F.coalesce(names_align(F.col("corp_name"), F.col("listed_name")), F.lit(False))
    verdict = both.groupBy(unit).agg(
        F.count("_in_sheet").alias("n_sheet"), F.count("_in_list").alias("n_listed"), F.count_if(~aligned).alias("n_mismatched")
    )
    allowed = F.greatest(F.lit(ALLOWED_ROWS), F.floor(F.col("n_sheet") * ALLOWED_SHARE))
    verdict = verdict.withColumn("accepted", (F.col("n_sheet") == F.col("n_listed")) & (F.col("n_mismatched") <= allowed))
    joined = sheet.join(listed, [unit, position]).join(verdict.where("accepted").select(unit), unit, "left_semi")
    return joined, verdict


def ambiguous_groups(index: DataFrame) -> DataFrame:
    """(name, unit, codes): companies of one name and unit, whose rows may have been swapped."""
    rows = index.where("coalesce(corp_name_norm, '') <> '' and coalesce(corp_code, '') <> ''")
    groups = rows.groupBy(F.col("corp_name_norm").alias("name"), F.coalesce("crawl_induty_code", F.lit("")).alias("unit"))
    return groups.agg(F.array_sort(F.collect_list("corp_code")).alias("codes")).where(F.size("codes") > 1)


def repair_swapped(index: DataFrame, profiles: DataFrame, attributes: list[str]) -> DataFrame:
    """Rows of ambiguous groups with the attributes that belong to their company.

    ``profiles`` (corp_code and the columns it is authoritative for, among them jurir_no)
    tells each company's number; the group's row with that number holds its attributes. If
    no row has it, the profile's own fields are taken and the industry's name is cleared.
    """
    number = corporate_number(F.col("jurir_no"))
    # members of a group are found by its count, so no group is put together in one row
    rows = index.withColumns({"name": F.nullif("corp_name_norm", F.lit("")), "unit": F.coalesce("crawl_induty_code", F.lit(""))}).where("name is not null and coalesce(corp_code, '') <> ''")
    many = rows.groupBy("name", "unit").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    mine = materialised(rows.join(many, ["name", "unit"]).withColumn("_number", F.col("jurir_no")))
    source = mine.where("jurir_no is not null and jurir_no <> ''").select("name", "unit", F.col("_number").alias("_want"), F.struct(*attributes).alias("_from"))
    source = source.groupBy("name", "unit", "_want").agg(F.min("_from").alias("_from"))
    known = [c for c in profiles.columns if c in attributes and c != "jurir_no"]
    wanted = profiles.select("corp_code", number.alias("_want"), *[F.col(c).alias(f"_p_{c}") for c in known])
    fixed = mine.join(wanted, "corp_code").join(source, ["name", "unit", "_want"], "left")
    found = F.col("_from").isNotNull()

    def value(c):
        if c == "jurir_no":
            other = F.col("_want")
        elif c in known:
            other = F.col(f"_p_{c}")
        elif c == "induty_name":
            other = F.lit(None).cast("string")
        else:
            other = F.col(c)
        return F.when(found, F.col(f"_from.{c}")).otherwise(other).alias(c)

    kept = [c for c in index.columns if c not in attributes]
    fixed = fixed.select(*kept, *[value(c) for c in attributes], F.when(~found, "fallback").when(~F.col("_from.jurir_no").eqNullSafe(F.col("_number")), "repaired").otherwise("kept").alias("repair"))
    fixed = materialised(fixed)
    rest = index.join(fixed.select("corp_code"), "corp_code", "left_anti").withColumn("repair", F.lit("untouched"))
    return rest.unionByName(fixed.select(*rest.columns))


def names_to_codes(codes: DataFrame) -> DataFrame:
    """Per normalised name its codes, the most recently changed first."""
    rows = codes.select(company_name(F.col("corp_name")).alias("name"), F.struct(F.coalesce("modify_date", F.lit("")).alias("d"), "corp_code").alias("s")).where("name <> ''")
    return rows.groupBy("name").agg(F.transform(F.sort_array(F.collect_list("s"), asc=False), lambda s: s["corp_code"]).alias("codes"))


def resolve_homonyms(results: DataFrame, codes: DataFrame, filings: DataFrame, profiles: DataFrame, region: dict | None = None) -> DataFrame:
    """(id, corp_code, rcept_no) of results without filings that get another company of their name.

    A code is taken if it isn't used in the job, has filings, and lies where the result's
    address lies (or in the job's region, if that can't be told). Results of one name choose
    one after the other by id, the most recently changed code first, each taking its code out
    of the others' choice. Where all addresses of a name tell the district, results and codes
    of a district are matched by their places in two distributed orders. Only names with an
    address that doesn't tell it are resolved name by name, in linear work and without pairs.
    """
    latest = filings.groupBy("corp_code").agg(F.max("rcept_no").alias("rcept_no"))
    lost = results.join(latest.select("corp_code"), "corp_code", "left_anti")
    want = lost.select("id", company_name(F.col("corp_name")).alias("name"), address_parts(F.col("address")).alias("w")).where("name <> ''").select("id", "name", "w.sido", "w.sigungu")
    want = materialised(want)
    usable = codes.join(results.select("corp_code").distinct(), "corp_code", "left_anti").join(latest, "corp_code").join(profiles.select("corp_code", F.col("address").alias("_a")), "corp_code")
    usable = usable.select("corp_code", "rcept_no", company_name(F.col("corp_name")).alias("name"), F.coalesce("modify_date", F.lit("")).alias("modify_date"), address_parts(F.col("_a")).alias("p"))
    usable = usable.select("corp_code", "rcept_no", "name", "modify_date", "p.sido", "p.sigungu")
    usable = materialised(usable.withColumn("in_region", in_region(F.col("sido"), F.col("sigungu"), region)))
    vague = want.where("sido is null or sigungu is null").select("name").distinct()

    place = ["name", "sido", "sigungu"]
    mine = ranked_within(want.join(vague, "name", "left_anti"), place, [F.col("id")])
    newest = [F.col("modify_date").desc(), F.col("corp_code").desc()]
    theirs = ranked_within(usable.where("sido is not null and sigungu is not null").select(*place, "corp_code", "rcept_no", "modify_date"), place, newest)
    exact = mine.join(theirs, [*place, "place"]).select("id", "corp_code", "rcept_no")

    def greedy(want: pd.DataFrame, usable: pd.DataFrame) -> pd.DataFrame:
        want, usable = (x.astype(object).where(x.notna(), None) for x in (want, usable))
        usable = usable.sort_values(["modify_date", "corp_code"], ascending=False)
        free: dict[tuple, list[tuple]] = {}  # by district, by province, in the region: the last one is next
        for row in reversed(list(usable.itertuples(index=False))):
            keys = {(row.sido, None)} if row.sido else set()
            keys |= {(row.sido, row.sigungu)} if row.sigungu else set()
            keys |= {(None, None)} if row.in_region else set()
            for key in keys:
                free.setdefault(key, []).append((row.corp_code, row.rcept_no))
        taken, out = set(), []
        for row in want.sort_values("id").itertuples(index=False):
            own = free.get((row.sido, row.sigungu or None), [])
            while own and own[-1][0] in taken:
                own.pop()
            if own:
                code, rcept_no = own.pop()
                taken.add(code)
                out.append((row.id, code, rcept_no))
        return pd.DataFrame(out, columns=["id", "corp_code", "rcept_no"])

    rest = want.join(vague, "name", "left_semi").groupBy("name").cogroup(usable.join(vague, "name", "left_semi").groupBy("name"))
    return exact.unionByName(rest.applyInPandas(greedy, "id long, corp_code string, rcept_no string"))
