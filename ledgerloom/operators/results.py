"""The query over a job's results: filters, order, pages, histograms and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from . import predicates as P
from .ordering import ranked_within

SEARCHED = ["corp_name", "address", "ceo_name", "induty_name", "auditor_name"]
CONTAINS = ["corp_name", "address", "induty_name"]
VALUES = ["induty_name", "auditor_name", "audit_opinion"]
RANGES = ["revenue_cur", "total_assets_cur"]
FLAGS = ["excluded_by_revenue", "excluded_by_assets", "excluded_by_stale_disclosure"]


def where(job_id: int | None = None, **f) -> Column:
    """All given filters at once. Keys: q, <column>_contains, <column>_not_contains, <column>_in,
    <column>_not_in, <column>_min, <column>_max, the flags, has_disclosure, status and auditor_changed."""
    tests = [F.col("job_id") == job_id] if job_id is not None else []
    tests.append(P.keyword([F.col(c) for c in SEARCHED], P.checked_text(f.get("q"))))
    for c in CONTAINS:
        tests.append(P.text_filter(F.col(c), P.checked_text(f.get(f"{c}_contains"))))
        tests.append(P.text_filter(F.col(c), P.checked_text(f.get(f"{c}_not_contains")), exclude=True))
    for c in VALUES:
        tests.append(P.value_filter(F.col(c), P.checked_values(f.get(f"{c}_in")), P.checked_values(f.get(f"{c}_not_in"))))
    for c in RANGES:
        tests.append(P.amount_between(F.col(c), f.get(f"{c}_min"), f.get(f"{c}_max")))
    for c in FLAGS:
        tests.append(P.flag_filter(F.col(c), f.get(c)))
    if f.get("has_disclosure") is not None:
        tests.append(F.col("rcept_no").isNotNull() == F.lit(f["has_disclosure"]))
    status = P.checked_enum(f.get("status"), P.STATUSES)
    if status is not None:
        tests.append(P.status_of(F.col("rcept_no"), F.col("parse_status")).isin(status) if status else F.lit(False))
    changed = P.checked_enum(f.get("auditor_changed"), P.CHANGES)
    if changed is not None:
        tests.append(P.change_of(F.col("auditor_changed")).isin(changed) if changed else F.lit(False))
    return P.all_of(*tests)


def sort_keys(spec: str | None, allowed: list[str], sort_by: str | None = None, sort_dir: str = "asc") -> list[tuple[str, str]]:
    """(field, direction) of a text such as ``a:desc,b:asc``; what is unknown is left out, the first of a field counts."""
    found: dict[str, str] = {}
    for part in (spec or "").split(","):
        name, _, way = (x.strip() for x in part.partition(":"))
        if name in allowed and way in ("asc", "desc"):
            found.setdefault(name, way)
    if not found and sort_by in allowed and sort_dir in ("asc", "desc"):
        found[sort_by] = sort_dir
    return list(found.items())


def order(keys: list[tuple[str, str]], tie: str = "id") -> list[Column]:
    """Nulls come last in both directions; ties go by id."""
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in keys] + [F.col(tie).asc()]


def with_place(df: DataFrame, keys: list[tuple[str, str]], groups: list[str], tie: str = "id") -> DataFrame:
    """Add each row's place in the order of its job, also where one job has very many rows."""
    return ranked_within(df, groups, order(keys, tie))


def page(df: DataFrame, keys: list[tuple[str, str]], number: int = 1, size: int = 50, tie: str = "id") -> DataFrame:
    if number < 1 or not 1 <= size <= 500:
        raise P.BadRequest("page from 1, size from 1 to 500")
    return df.orderBy(*order(keys, tie)).offset((number - 1) * size).limit(size)


def listing(results: DataFrame, job_id: int, keys: list[tuple[str, str]] = (), number: int = 1, size: int = 50, ids_only: bool = False, **filters) -> tuple[int, DataFrame]:
    """The number of matching rows and their page, or all their ids in order."""
    found = results.where(where(job_id, **filters))
    if ids_only:
        return found.count(), found.orderBy(*order(list(keys))).select("id")
    return found.count(), page(found, list(keys), number, size)


def value_histogram(df: DataFrame, column: str, q: str | None = None, limit: int | None = 2000) -> DataFrame:
    """Non-blank values with their counts, the most frequent first; all of them, unordered, with no ``limit``."""
    c = F.col(column)
    rows = df.where(~is_blank(c)).where(P.text_filter(c, P.checked_text(q)))
    counts = rows.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts if limit is None else counts.orderBy(F.desc("n"), "value").limit(max(limit, 1))


def value_totals(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.countDistinct(F.when(~is_blank(c), c)).alias("n_distinct"), F.count_if(is_blank(c)).alias("n_blank"), F.count(F.lit(1)).alias("n_rows")
    )


def selection_summary(results: DataFrame, snapshots: DataFrame, ids: DataFrame) -> DataFrame:
    """Seven counts over the selected ids, which may overlap."""
    chosen = results.join(ids.select("id").distinct(), "id", "left_semi")
    history = snapshots.select(F.col("result_id").alias("id")).distinct().withColumn("known", F.lit(True))
    rows = chosen.join(history, "id", "left")

    def on(c):
        return F.count_if(F.coalesce(F.col(c) == 1, F.lit(False)))

    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        on("excluded_by_stale_disclosure").alias("stale"),
        on("excluded_by_revenue").alias("out_of_revenue"),
        on("excluded_by_assets").alias("out_of_assets"),
        F.count_if(F.col("rcept_no").isNotNull() & F.coalesce(F.col("parse_status") == "FAILED", F.lit(False))).alias("failed"),
        F.count_if(F.col("rcept_no").isNull()).alias("no_disclosure"),
        F.count_if(F.col("known").isNull()).alias("no_history"),
    )


def foreign_ids(results: DataFrame, ids: DataFrame, job_id: int) -> DataFrame:
    """Selected ids that aren't the job's."""
    return ids.select("id").distinct().join(results.where(F.col("job_id") == job_id), "id", "left_anti")


def owned_filings(results: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(result_id, rcept_no): the filings that may be opened for a result, its own and its years'."""
    own = results.select(F.col("id").alias("result_id"), "rcept_no")
    return own.union(snapshots.select("result_id", "rcept_no")).where("rcept_no is not null").distinct()


def toggled(results: DataFrame, result_id: int, excluded: bool) -> DataFrame:
    return results.withColumn("excluded_manually", F.when(F.col("id") == result_id, int(excluded)).otherwise(F.col("excluded_manually")))


def reset_failed(results: DataFrame) -> DataFrame:
    """Failed rows with a filing are to be read again; those without one stay."""
    again = F.coalesce((F.col("parse_status") == "FAILED") & F.col("rcept_no").isNotNull(), F.lit(False))
    return results.withColumns({c: F.when(~again, F.col(c)) for c in ("parse_status", "parse_note")})


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def without_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").join(b.select("id"), "id", "left_anti")


def without_descendants(codes: DataFrame) -> DataFrame:
    """Chosen codes without those that a chosen shorter code covers."""
    prefixes = codes.select(F.col("code"), F.explode(F.sequence(F.lit(1), F.greatest(F.length("code") - 1, F.lit(1)))).alias("n"))
    covered = prefixes.where(F.length("code") > 1).select("code", F.substring("code", F.lit(1), F.col("n")).alias("prefix"))
    hit = covered.join(codes.select(F.col("code").alias("prefix")), "prefix", "left_semi").select("code").distinct()
    return codes.join(hit, "code", "left_anti")
