"""Admission of calls under a daily limit, from a stream of attempts.

A day's attempts are admitted in the order of time and id while its count is below the limit;
the others are refused and don't count. A micro-batch gets its places inside each day from a
distributed order, so a day with most of the attempts is spread over tasks; the only state is
how many calls each day has used, a row per day, and it ends with the day. Each batch writes
its outcome and its state as folders of its own number, so a batch that runs again after a
restart gives the same and counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import materialised, ranked_within

USED = "day date, used long"


def admitted(attempts: DataFrame, used: DataFrame, limit: int, time: str = "time", key: str = "id") -> DataFrame:
    """Attempts with ``day``, ``admitted`` and ``call`` (the day's count after it; null if refused)."""
    rows = attempts.withColumn("day", F.to_date(time))
    placed = ranked_within(rows, ["day"], [time, key], "_place").join(used.withColumnRenamed("used", "_used"), "day", "left")
    call = F.col("_place") + F.coalesce("_used", F.lit(0))
    return placed.withColumn("call", F.when(call <= limit, call)).withColumn("admitted", F.col("call").isNotNull()).drop("_place", "_used")


def state_before(spark: SparkSession, target: str, batch: int) -> DataFrame:
    """(day, used) after the batch before; empty for the first."""
    if batch == 0:
        return spark.createDataFrame([], USED)
    return spark.read.schema(USED).parquet(f"{target}/state/batch={batch - 1}")


def start(stream: DataFrame, target: str, checkpoint: str, limit: int, time: str = "time", key: str = "id", days_kept: int = 2) -> StreamingQuery:
    """Write outcomes to ``target``/outcome and the state to ``target``/state; days older than the newest by ``days_kept`` leave the state.

    Attempts of a day that has left the state are refused: the day is over.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        before = materialised(state_before(spark, target, number))
        newest = before.agg(F.max("day")).first()[0]
        rows = batch
        late = F.lit(False) if newest is None else F.coalesce(F.to_date(time) <= F.date_sub(F.lit(newest), days_kept), F.lit(False))
        open_ = admitted(rows.where(~late), before, limit, time, key)
        over = rows.where(late).withColumns({"day": F.to_date(time), "call": F.lit(None).cast("long"), "admitted": F.lit(False)})
        outcome = f"{target}/outcome/batch={number}"
        open_.unionByName(over).write.mode("overwrite").parquet(outcome)
        done = spark.read.schema(open_.schema).parquet(outcome).where("admitted").groupBy("day").agg(F.max("call").alias("used"))
        state = before.unionByName(done.select("day", "used")).groupBy("day").agg(F.max("used").alias("used"))
        last = state.agg(F.max("day")).first()[0]
        state = state.where(F.col("day") > F.date_sub(F.lit(last), days_kept)) if last else state
        state.write.mode("overwrite").parquet(f"{target}/state/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcomes(spark: SparkSession, target: str, kinds: str) -> DataFrame:
    """All attempts with their outcome."""
    return spark.read.schema(f"{kinds}, day date, call long, admitted boolean").parquet(f"{target}/outcome").drop("batch")
