"""Yearly snapshots kept up to date from a stream of parsed filings.

A batch of filings gives each year an own or a borrowed row; the own one counts, then the
newest filing. Each micro-batch is merged with the buckets that its companies lie in, and only
these are written anew, in one commit; a repeated batch gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versioned import Store

KEYS = ["result_id", "fiscal_year"]
SCHEMA = "result_id long, fiscal_year string, rcept_no string, from_current_period int, revenue long"
BUCKETS = 64
#: versions that stay readable behind the newest
VERSIONS = 3


def best_rows(rows: DataFrame) -> DataFrame:
    """One row per company and year: own before borrowed, then the newest filing."""
    rest = [c for c in rows.columns if c not in KEYS]
    best = F.max_by(F.struct(*rest), F.struct("from_current_period", "rcept_no")).alias("b")
    return rows.groupBy(*KEYS).agg(best).select(*KEYS, "b.*")


def merge(table: DataFrame | None, batch: DataFrame) -> DataFrame:
    return best_rows(batch if table is None else table.unionByName(batch))


def _store(spark: SparkSession, target: str) -> Store:
    return Store(spark, target, {"snapshots": "result_id"}, BUCKETS)


def start(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read landed JSON filings as a stream and keep the table at ``target``."""
    stream = spark.readStream.schema(SCHEMA).json(source)

    def write(batch: DataFrame, number: int) -> None:
        store = _store(batch.sparkSession, target)
        base = store.version()
        if not base:
            store.commit(0, {"snapshots": merge(None, batch)})
            return
        table = store.table("snapshots", base)
        touched = [r[0] for r in batch.select(store.bucket("snapshots")).distinct().collect()]  # at most as many as there are buckets
        old = table.where(store.bucket("snapshots").isin(touched) if touched else F.lit(False))
        store.commit(base, {"snapshots": merge(old, batch)}, {"snapshots": touched})
        store.forget(VERSIONS)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, version: int | None = None) -> DataFrame | None:
    """The newest state of the table, or that of a version; None before the first batch."""
    store = _store(spark, target)
    return store.table("snapshots", version) if store.version() else None
