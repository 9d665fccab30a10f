"""Latest rows, upserts and yearly reference figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import whole_number
from ..functions.text import blank_to_null, stripped


def latest_per_key(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row per key, the last in the order of ``by``; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*by)).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], load_order: str) -> DataFrame:
    """Old rows replaced by new ones of the same key; in the new ones the last loaded counts.

    Missing amounts of a new row replace older ones: nothing is filled in. Columns that one
    side lacks are null.
    """
    last = latest_per_key(new, keys, [load_order]).drop(load_order)
    return old.join(last, keys, "left_anti").unionByName(last, allowMissingColumns=True)


def with_values(state: DataFrame, new: DataFrame, load_order: str) -> DataFrame:
    """A table of (key, value) with new values set, such as times of the last load; the last of each key counts."""
    return latest_per_key(state.unionByName(new), ["key"], [load_order])


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys an upsert would insert and update."""
    known = old.select(*keys).distinct().withColumn("known", F.lit(1))
    return new.select(*keys).distinct().join(known, keys, "left").agg(
        F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if(F.col("known").isNotNull()).alias("updated")
    )


def yearly_stats(items: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """Rows of a yearly page that can be used: separate statements with a number and a year.

    ``amounts`` maps result columns to the page's columns.
    """
    crno, year = blank_to_null(F.col("crno")), blank_to_null(F.col("bizYear"))
    usable = (F.col("fnclDcd") == "120") & crno.isNotNull() & (crno != "0" * 13) & year.isNotNull()
    return items.where(usable).select(crno.alias("crno"), year.alias("biz_year"), *[whole_number(F.col(v)).alias(k) for k, v in amounts.items()])


def latest_stats(stats: DataFrame) -> DataFrame:
    return latest_per_key(stats, ["crno"], ["biz_year"])


def distinct_years(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_set("biz_year")).alias("years"))


def with_latest_stat(candidates: DataFrame, stats: DataFrame, amounts: list[str]) -> DataFrame:
    """Candidates with the figures of the latest year; a blank number never matches."""
    ref = latest_stats(stats).select(F.col("crno").alias("jurir_no"), *[F.col(a).alias(f"ref_{a}") for a in amounts])
    return candidates.join(ref.where("jurir_no is not null and jurir_no <> ''"), "jurir_no", "left")


def new_candidates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates that the job doesn't have yet; of repeated codes the first stays."""
    first = Window.partitionBy("corp_code").orderBy("position")
    fresh = candidates.join(existing.select("corp_code").distinct(), "corp_code", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def latest_filings(filings: DataFrame) -> DataFrame:
    """The filing with the largest number of each company; rows without code or number are left out."""
    known = filings.where("coalesce(corp_code, '') <> '' and coalesce(rcept_no, '') <> ''")
    return latest_per_key(known, ["corp_code"], ["rcept_no"])


def filing_windows(periods: DataFrame, begin: str = "begin", end: str = "end", days: int = 90) -> DataFrame:
    """Closed windows of at most ``days`` days that tile each period; an inverted period is an error."""
    ok = F.assert_true(F.col(begin) <= F.col(end), F.lit("period begins after its end"))
    starts = periods.withColumn("_ok", ok).where("_ok is null").withColumn("window_begin", F.explode(F.expr(f"sequence({begin}, {end}, interval {days} days)")))
    return starts.withColumn("window_end", F.least(F.date_add("window_begin", days - 1), F.col(end))).drop("_ok")


def with_latest_filing(results: DataFrame, filings: DataFrame) -> DataFrame:
    """Results with their company's latest filing; without one they are failed, stale and without amounts."""
    last = latest_filings(filings.select("corp_code", "rcept_no")).withColumnRenamed("rcept_no", "latest_rcept_no")
    rows = results.join(last, "corp_code", "left")
    none = F.col("latest_rcept_no").isNull()
    return rows.withColumns(
        {
            "rcept_no": F.col("latest_rcept_no"),
            "parse_status": F.when(none, "FAILED").otherwise(F.col("parse_status")),
            "revenue_cur": F.when(~none, F.col("revenue_cur")),
            "total_assets_cur": F.when(~none, F.col("total_assets_cur")),
            "excluded_by_stale_disclosure": F.when(none, 1).otherwise(F.col("excluded_by_stale_disclosure")),
        }
    ).drop("latest_rcept_no")


def download_order(rows: DataFrame) -> DataFrame:
    """Filing numbers in the order of (score, id); each once, where it comes first."""
    first = rows.where("rcept_no is not null").groupBy("rcept_no").agg(F.min(F.struct("score", "id")).alias("at"))
    return first.select("rcept_no", F.col("at.score").alias("score"), F.col("at.id").alias("id"))


def shortest_codes(tree: DataFrame) -> DataFrame:
    """Per normalised industry name the shortest code of digits, the first of equal length."""
    from ..functions.text import industry_name

    rows = tree.where(F.col("code").rlike(r"^\d+$")).select(industry_name(F.col("name")).alias("name"), "code", "position")
    return rows.groupBy("name").agg(F.min_by("code", F.struct(F.length("code"), "position")).alias("code"))


def mid_level_codes(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("code").rlike(r"^\d{2}$")).select("code").distinct()


def code_list(rows: DataFrame) -> DataFrame:
    """Company codes as landed: blank codes are left out, blank texts become null."""
    code = stripped(F.col("corp_code"))
    return rows.where(code != "").select(code.alias("corp_code"), stripped(F.col("corp_name")).alias("corp_name"), *[blank_to_null(F.col(c)).alias(c) for c in ("stock_code", "modify_date")])
