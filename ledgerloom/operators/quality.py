"""Audits of stored figures: identities between items, drift between versions, backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(total: Column, parts: Column, tolerance: int = 1) -> Column:
    """How a total stands to what it should be: ok, sign_flip, magnitude_off, or unknown."""
    off = F.abs(total - parts)
    return (
        F.when(off.isNull(), "unknown")
        .when(off <= tolerance, "ok")
        .when(F.abs(F.abs(total) - F.abs(parts)) <= tolerance, "sign_flip")
        .otherwise("magnitude_off")
    )


def identities(df: DataFrame) -> DataFrame:
    """Counts by identity and verdict: gross profit, assets by term, assets by source."""
    checks = {
        "gross_profit": identity(F.col("gross_profit"), F.col("revenue") - F.col("cogs")),
        "assets_by_term": identity(F.col("total_assets"), F.col("current_assets") + F.col("noncurrent_assets")),
        "assets_by_source": identity(F.col("total_assets"), F.col("total_liab") + F.col("total_equity")),
    }
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("identity"), v.alias("verdict")) for k, v in checks.items()])).alias("e"))
    return rows.groupBy("e.identity", "e.verdict").agg(F.count(F.lit(1)).alias("n"))


def drift(now: DataFrame, before: DataFrame, but: list[str] = ()) -> DataFrame:
    """Distinct rows that changed outside the columns that may change."""
    columns = [c for c in now.columns if c not in but]
    return now.select(*columns).subtract(before.select(*columns))


def transitions(now: DataFrame, before: DataFrame, key: str, column: str) -> DataFrame:
    """Counts of (old, new) values of a column by key; nulls are values."""
    both = before.select(key, F.col(column).alias("old")).join(now.select(key, F.col(column).alias("new")), key)
    return both.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def changed_ids(now: DataFrame, before: DataFrame, key: str, column: str) -> DataFrame:
    both = before.select(key, F.col(column).alias("old")).join(now.select(key, F.col(column).alias("new")), key)
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def resolved_period(filing_date: Column, fiscal_year: Column, from_current: Column) -> Column:
    """Which column of a filing a year's figures come from: cur, prv, or null to skip."""
    filed = F.substring(filing_date, 1, 4).try_cast("int")
    year = fiscal_year.try_cast("int")
    return F.when(filed.isNull(), F.when(from_current == 1, "cur").otherwise("prv")).when(filed == year, "cur").when(filed == year + 1, "prv")


def filled(stored: DataFrame, parsed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows whose nulls in ``columns`` are filled from parsed ones."""
    new = parsed.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = stored.join(new, key, "left")
    return out.withColumns({c: F.coalesce(c, f"_new_{c}") for c in columns}).drop(*[f"_new_{c}" for c in columns])


def overwritten(stored: DataFrame, parsed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with parsed values where a parsed row is there, also null ones, and whether any differs."""
    new = parsed.select(key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = stored.join(new, key, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    out = out.withColumn("changed", F.coalesce(F.col("_there") & differs, F.lit(False)))
    return out.withColumns({c: F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop("_there", *[f"_new_{c}" for c in columns])


def without_history(results: DataFrame, snapshots: DataFrame) -> DataFrame:
    return results.join(snapshots.select(F.col("result_id").alias("id")).distinct(), "id", "left_anti")


def with_history(results: DataFrame, snapshots: DataFrame) -> DataFrame:
    return results.join(snapshots.select(F.col("result_id").alias("id")).distinct(), "id", "left_semi")
