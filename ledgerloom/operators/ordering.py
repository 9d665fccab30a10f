"""Tables written once for several uses, and places in a global order without one task for all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only in local mode, where it is unset, a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ranked(df: DataFrame, keys: list, place: str = "place", counted=None) -> DataFrame:
    """Add the place (from 1) of each row in the order of ``keys``; ``counted`` says which rows count, or how often each does.

    The rows are range-partitioned and sorted; a row's place is its place in its partition plus
    the rows of the partitions before it. Two numbers per partition reach the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1) if counted is None else counted.cast("long")
    placed = materialised(
        df.withColumn("_one", one).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    start, before = 0, []
    for r in sorted(placed.groupBy("_part").agg(F.sum("_one").alias("n")).collect()):  # one row per partition
        before.append((r["_part"], start))
        start += r["n"]
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    # the low 33 bits of a row's number count the rows of its partition, so nothing is shuffled for places of all rows
    inside = F.sum("_one").over(Window.partitionBy("_part").orderBy("_row")) if counted is not None else F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn(place, inside).join(F.broadcast(offsets), "_part").withColumn(place, F.col(place) + F.col("_before")).drop("_part", "_row", "_one", "_before")


def ranked_within(df: DataFrame, groups: list[str], keys: list, place: str = "place") -> DataFrame:
    """Add the place (from 1) of each row inside its group in the order of ``keys``.

    All groups stand one behind the other in one range-sorted order, so that a group with very
    many rows is spread. A row's place is its place in its partition plus the group's rows in
    the partitions before it; of a group there is one number per partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*groups, *keys]
    placed = materialised(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a group's rows follow each other in a partition: a row's place there is its distance from the first of them
    counts = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    counts = counts.select(F.col("_part").alias("_p"), "_before", "_first", *[F.col(g).alias(f"_g_{g}") for g in groups])
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(counts, same).select(*df.columns, (F.col("_row") - F.col("_first") + 1 + F.col("_before")).alias(place))
