"""Landed files as DataFrames: pages of JSON, zipped code lists, sheets, list pages, documents.

What comes over a network is landed as files first; everything here reads folders that
Spark can list, so one job takes all pages at once.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, stripped

# fixed values: the columns of the company sheet, by position
SHEET = [
    "corp_name", "eng_name", "disclosure_name", "stock_code", "corp_cls", "ceo_name", "jurir_no", "bizr_no", "address", "homepage",
    "induty_name", "phone", "est_date", "acc_month",
]


def stat_pages(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Items of landed pages of yearly figures; an item list may be missing, a list or one object.

    Columns are those ``fields``, as texts, with ``page`` (the file) beside them.
    """
    item = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("page"))
    many = F.from_json(F.get_json_object("value", "$.response.body.items.item"), T.ArrayType(item))
    one = F.from_json(F.get_json_object("value", "$.response.body.items.item"), item)
    listed = F.get_json_object("value", "$.response.body.items.item").startswith("[")
    items = F.when(listed, many).otherwise(F.when(F.get_json_object("value", "$.response.body.items.item").isNotNull(), F.array(one)))
    return raw.select("page", F.explode(items).alias("i")).select("page", "i.*")


def page_totals(spark: SparkSession, path: str, size: int = 5000) -> DataFrame:
    """(page, total, n_pages) that landed pages announce."""
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("page"))
    total = F.coalesce(F.get_json_object("value", "$.response.body.totalCount").try_cast("int"), F.lit(0))
    return raw.select("page", total.alias("total"), F.ceil(total / size).cast("int").alias("n_pages"))


def filing_pages(spark: SparkSession, path: str) -> DataFrame:
    """Filings of landed list pages: corp_code, corp_name, rcept_no, rcept_dt."""
    kind = "array<struct<corp_code:string,corp_name:string,rcept_no:string,rcept_dt:string>>"
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json(F.get_json_object("value", "$.list"), kind)).alias("f")).select("f.*")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Landed company profiles, one JSON object per file; failed answers are left out."""
    fields = ["status", "corp_code", "corp_name", "ceo_nm", "jurir_no", "bizr_no", "adres", "induty_code", "est_dt", "acc_mt"]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("p")).select("p.*").where("status = '000'")
    names = {"ceo_nm": "ceo_name", "adres": "address", "est_dt": "est_date", "acc_mt": "acc_month"}
    return rows.select("corp_code", *[blank_to_null(F.col(c)).alias(names.get(c, c)) for c in fields[2:]])


def list_pages(spark: SparkSession, path: str) -> DataFrame:
    """(unit, page, position, corp_code, listed_name, n_pages) of landed HTML list pages.

    Files are named unit=<unit>/<page>.html; the order of rows is part of their meaning.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    unit, page = F.regexp_extract("file", r"unit=([^/]+)", 1), F.regexp_extract("file", r"(\d+)\.html?$", 1).try_cast("int")
    rows = raw.select(unit.alias("unit"), page.alias("page"), F.col("value"))
    return listed_companies(rows, "value")


def listed_companies(rows: DataFrame, html: str) -> DataFrame:
    """Rows of list pages: every eight-digit code with its name, in page order."""
    pattern = r"openCorpInfo(?:New)?\('(\d{8})'[^>]*>([^<]*)<"
    codes, names = F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2)
    total = F.coalesce(F.regexp_extract(html, r"\[\d+/(\d+)\]", 1).try_cast("int"), F.lit(1))
    pairs = F.posexplode(F.arrays_zip(codes.alias("code"), names.alias("name"))).alias("position", "p")
    out = rows.withColumn("n_pages", total).select(*[c for c in rows.columns if c != html], "n_pages", pairs)
    return out.select(*[c for c in out.columns if c != "p"], F.col("p.code").alias("corp_code"), stripped(F.col("p.name")).alias("listed_name"))


def code_zip(spark: SparkSession, path: str) -> DataFrame:
    """Companies of zipped code lists: the first XML file of each zip, one row per <list>."""
    fields = ["corp_code", "corp_name", "stock_code", "modify_date"]

    def run(batches):
        for pdf in batches:
            rows = []
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
                    if name:
                        with z.open(name) as f:
                            for _, node in ElementTree.iterparse(f):
                                if node.tag == "list":
                                    rows.append([node.findtext(x) for x in fields])
                                    node.clear()
            yield pd.DataFrame(rows, columns=fields)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{f} string" for f in fields))
    code = stripped(F.col("corp_code"))
    return raw.where(code != "").select(code.alias("corp_code"), stripped(F.col("corp_name")).alias("corp_name"), *[blank_to_null(F.col(c)).alias(c) for c in fields[2:]])


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_rows(raw: bytes) -> list[list[str | None]]:
    """Rows of the first sheet of a workbook."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        name = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        out = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{ns}row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{ns}c"):
                value = c.findtext(f"{ns}v")
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                cells[_column(c.get("r"))] = value
            out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        return out


def company_sheets(spark: SparkSession, path: str, columns: list[str] = SHEET) -> DataFrame:
    """Rows of landed company sheets by position; a sheet with another number of columns is an error.

    Files lie in unit=<unit>/ folders. Blank rows and rows without a name are left out.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                unit = re.search(r"unit=([^/]+)", file)
                header, *body = _sheet_rows(raw) or [[]]
                if len(header) != len(columns):
                    raise ValueError(f"{file}: {len(header)} columns instead of {len(columns)}")
                for r in body:
                    r = [(x or "").strip() or None for x in (r + [None] * len(columns))[: len(columns)]]
                    if r[0]:
                        rows.append([unit[1] if unit else None, len(rows), *r])
            yield pd.DataFrame(rows, columns=["unit", "position", *columns])

    kinds = "unit string, position int, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kinds)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed filing documents (rcept_no=<number>/...): per filing the first XML file, else the first PDF."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"rcept_no=([^/]+)", 1)
    kind = extension(F.col("path"))
    rank = F.when(kind == "XML", 0).when(kind == "PDF", 1)
    chosen = files.select(number.alias("rcept_no"), "path", rank.alias("rank")).where("rank is not null").groupBy("rcept_no").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return files.select("path", "content").join(chosen, "path").select("rcept_no", "path", extension(F.col("path")).alias("kind"), "content")


def extension(path: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("")), F.lit("UNKNOWN"))


def is_stale(meta: dict | None, now: pd.Timestamp, days: int, empty: bool) -> bool:
    """Whether landed data must be fetched again: none, no readable date, or too old."""
    try:
        then = pd.Timestamp((meta or {})["updated_at"])
    except (KeyError, ValueError, TypeError):
        return True
    return empty or pd.isna(then) or now - then > pd.Timedelta(days=days)


def coverage(sample: DataFrame, matched: str = "matched") -> DataFrame:
    """Share of a sample that a source covers, and whether it reaches four fifths."""
    share = F.try_divide(F.count_if(F.col(matched)), F.count(F.lit(1)))
    return sample.agg(F.count(F.lit(1)).alias("n"), share.alias("coverage"), F.coalesce(share >= 0.8, F.lit(False)).alias("adopted"))
