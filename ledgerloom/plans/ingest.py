"""Unit-wise ingest into tables: resumable, idempotent, with a manifest of what is complete."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import address_parts, company_name, corporate_number, industry_name
from ..operators import latest, matching


def index_rows(sheet: DataFrame, listed: DataFrame, codes_by_name: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Company index rows of the units whose sheet and list line up, and the verdict per unit."""
    joined, verdict = matching.positional_join(sheet, listed)
    known = codes_by_name.select(F.col("name").alias("_n"), F.col("code").alias("_c"))
    rows = joined.join(known, industry_name(F.coalesce("induty_name", F.lit(""))) == F.col("_n"), "left")
    place = address_parts(F.col("address"))
    rows = rows.withColumns(
        {
            "corp_name_norm": company_name(F.col("corp_name")), "jurir_no": corporate_number(F.col("jurir_no")), "bizr_no": corporate_number(F.col("bizr_no")),
            "sido": place["sido"], "sigungu": place["sigungu"], "induty_code": F.coalesce("_c", "unit"), "crawl_induty_code": F.col("unit"),
        }
    )
    return rows.drop("_n", "_c", "listed_name"), verdict


def completed(spark: SparkSession, manifest: str) -> set[str]:
    """Units that an earlier run has finished; some tens of names."""
    try:
        return {r["unit"] for r in spark.read.json(manifest, schema="unit string, rows long, at string").where("rows is not null").collect()}
    except Exception as e:  # no manifest yet
        if "PATH_NOT_FOUND" in str(e):
            return set()
        raise


def ingest(spark: SparkSession, units: list[str], read: Callable[[str], DataFrame], target: str, manifest: str, force: bool = False) -> dict[str, str]:
    """Write each unit's rows to its own partition of ``target``; a failing unit is reported and left for a later run.

    Partitions are overwritten one by one, so that a repeated run gives the same table.
    """
    done = set() if force else completed(spark, manifest)
    failed: dict[str, str] = {}
    for unit in sorted(set(units) - done):
        try:
            rows = read(unit).drop("unit")
            rows.write.mode("overwrite").parquet(f"{target}/unit={unit}")
            n = spark.read.parquet(f"{target}/unit={unit}").count()
        except Exception as e:
            failed[unit] = str(e).splitlines()[0][:300]
            continue
        entry = spark.createDataFrame([(unit, n, datetime.now().isoformat(timespec="seconds"))], "unit string, rows long, at string")
        entry.coalesce(1).write.mode("append").json(manifest)
    return failed


def supervised(run: Callable[[bool], dict[str, str]], force: bool = False, tries: int = 20) -> dict[str, str]:
    """Repeat an ingest until nothing fails; only the first try may start anew."""
    failed = run(force)
    for _ in range(tries - 1):
        if not failed:
            break
        failed = run(False)
    return failed


def index_status(index: DataFrame, crawled_at: str | None, reconciled_at: str | None) -> DataFrame:
    """Rows of the index and whether its ambiguous groups wait for repair."""
    pending = crawled_at is not None and (reconciled_at is None or reconciled_at < crawled_at)
    return index.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", ((F.col("n_rows") > 0) & F.lit(pending)).alias("reconcile_pending"))


def reconcile_calls(index: DataFrame) -> DataFrame:
    """How many groups and profile calls a repair would take."""
    return matching.ambiguous_groups(index).agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.size("codes")), F.lit(0)).cast("bigint").alias("n_calls"))


def merged_stats(old: DataFrame, pages: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """Yearly figures after a crawl: all pages in one batch, the last page of a key counts."""
    rows = latest.yearly_stats(pages, amounts).withColumn("_n", F.monotonically_increasing_id())
    return latest.upsert(old, rows, ["crno", "biz_year"], "_n")
