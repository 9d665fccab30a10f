"""Jobs: their states, and the two phases as batches over tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import filing_date, is_stale, range_flag
from ..operators import latest, predicates
from ..operators.bands import with_band_score
from ..operators.history import company_auditor_change, history_fold

HISTORY_YEARS = (2, 4, 6, 10)
RUNNING = {"PENDING", "RUNNING"}
ENDED = {"DONE", "CANCELLED"}
RESUMABLE = {"PAUSED_QUOTA", "FAILED"}


class NotAllowed(ValueError):
    """A step that the job's state doesn't allow."""


@dataclass(frozen=True)
class Job:
    id: int
    region: dict | None = None
    industry: tuple[str, ...] = ()
    revenue: dict | None = None
    assets: dict | None = None
    history_years: int = 4
    phase: str = "CANDIDATES"
    status: str = "PENDING"
    note: str | None = None

    def to_json(self) -> str:
        return json.dumps(self.__dict__, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Job:
        data = json.loads(text)
        return cls(**data | {"industry": tuple(data.get("industry") or ())})


def created(job: Job) -> Job:
    if job.history_years not in HISTORY_YEARS:
        raise predicates.BadRequest(f"history_years must be one of {HISTORY_YEARS}")
    return replace(job, region=predicates.checked_region(job.region) if job.region else None)


def cancelled(job: Job) -> Job:
    if job.status in ENDED:
        raise NotAllowed("the job has ended")
    return replace(job, status="CANCELLED")


def resumed(job: Job) -> Job:
    if job.status not in RESUMABLE:
        raise NotAllowed("only paused or failed jobs go on")
    return replace(job, status="RUNNING", note=None)


def financials_started(job: Job) -> Job:
    if (job.phase, job.status) != ("CANDIDATES", "DONE"):
        raise NotAllowed("candidates aren't complete")
    return replace(job, phase="FINANCIALS", status="RUNNING")


def deletable(job: Job) -> None:
    if job.status in RUNNING:
        raise NotAllowed("the job is running")


def without_job(table: DataFrame, job_id: int) -> DataFrame:
    return table.where(F.col("job_id") != job_id)


def listed(table: DataFrame) -> DataFrame:
    """Jobs, the latest first."""
    return table.orderBy(F.desc("id"))


def candidates(index: DataFrame, job: Job, children: dict[str, list[str]]) -> DataFrame:
    """Companies of the index that a job asks for: not listed, in its regions and industries."""
    prefixes = predicates.industry_prefixes(list(job.industry), children)
    return index.where(
        predicates.not_listed(F.col("corp_cls")) & predicates.in_region(F.col("sido"), F.col("sigungu"), job.region) & predicates.in_industry(F.col("induty_code"), prefixes)
    )


def preview(found: DataFrame, daily_limit: int, calls: int = 5) -> DataFrame:
    """How many candidates there are, how many a day allows, and how many days that takes."""
    per_day = max(1, daily_limit // calls)
    return found.agg(F.count(F.lit(1)).alias("n_candidates")).select("n_candidates", F.lit(per_day).alias("per_day"), F.ceil(F.col("n_candidates") / per_day).alias("days"))


def quota_status(usage: DataFrame, limit: int) -> DataFrame:
    """(date, used, remaining) by day of calls."""
    return usage.groupBy("date").agg(F.sum("n").alias("used")).select("date", "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).alias("remaining"))


def phase_one(index: DataFrame, stats: DataFrame, existing: DataFrame, job: Job, children: dict[str, list[str]]) -> DataFrame:
    """New results of a job: its candidates with the latest reference figures, without those it has."""
    fresh = latest.new_candidates(candidates(index, job, children).withColumn("position", F.col("corp_code")), existing).drop("position")
    return latest.with_latest_stat(fresh, stats, ["revenue", "total_assets"]).withColumn("job_id", F.lit(job.id))


def flagged(results: DataFrame, job: Job, today) -> DataFrame:
    """Results with the flags that their current amounts and filings give."""
    r, a = job.revenue or {}, job.assets or {}
    date = filing_date(F.col("rcept_no"))
    return results.withColumns(
        {
            "latest_disclosure_date": date,
            "excluded_by_revenue": range_flag(F.col("revenue_cur"), F.col("excluded_by_revenue"), r.get("min_krw"), r.get("max_krw")),
            "excluded_by_assets": range_flag(F.col("total_assets_cur"), F.col("excluded_by_assets"), a.get("min_krw"), a.get("max_krw")),
            "excluded_by_stale_disclosure": is_stale(date, F.lit(today).cast("date")).cast("int"),
        }
    )


def to_download(results: DataFrame, job: Job) -> DataFrame:
    """Filing numbers in the order in which documents are fetched: likely hits first."""
    return latest.download_order(with_band_score(results, job.revenue, job.assets))


def histories(results: DataFrame, filings: DataFrame, job: Job) -> DataFrame:
    """Which filing each year of the job's remaining companies comes from."""
    left = results.where("coalesce(excluded_by_revenue, 0) = 0 and coalesce(excluded_by_assets, 0) = 0 and coalesce(excluded_by_stale_disclosure, 0) = 0 and corp_code is not null")
    read = left.select(F.col("id").alias("result_id"), "corp_code").join(filings, "corp_code")
    return history_fold(read, job.history_years)


def with_auditor_flag(results: DataFrame, snapshots: DataFrame) -> DataFrame:
    change = company_auditor_change(snapshots, ["result_id"]).withColumnRenamed("result_id", "id")
    return results.drop("auditor_changed").join(change, "id", "left")
