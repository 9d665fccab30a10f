"""Walks through a table in a seeded order that end with a goal or a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import materialised


def walk_until(rows: DataFrame, key: str, hit: Column, goal: int, budget: int, seed: int = 0) -> DataFrame:
    """The rows that a walk in the order of a seeded hash of ``key`` takes, with ``call`` (from 1), ``hit`` and ``hits`` so far.

    The walk ends with the row that is the ``goal``-th hit, or after ``budget`` rows. Rows are
    range-sorted; where it ends follows from rows and hits by partition, two numbers of each
    reach the driver, and only the partition that the goal lies in is looked at more closely.
    The order is that of the digest's text, then of the key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    placed = rows.withColumns({"_order": order, "hit": F.coalesce(hit, F.lit(False))})
    placed = placed.repartitionByRange(n, "_order", key).sortWithinPartitions("_order", key)
    placed = materialised(placed.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    calls = found = 0
    starts, last = [], budget
    for part, count, hits in sorted(map(tuple, placed.groupBy("_part").agg(F.count(F.lit(1)), F.count_if("hit")).collect())):  # one row per partition
        starts.append((part, calls, found))
        if found < goal <= found + hits:
            inside = placed.where((F.col("_part") == part) & F.col("hit")).orderBy("_row").limit(goal - found).agg(F.max("_row")).first()[0]
            last = min(budget, calls + (inside & ((1 << 33) - 1)) + 1)
        calls, found = calls + count, found + hits
    if goal <= 0:
        last = 0
    before = rows.sparkSession.createDataFrame(starts, "_part int, _calls long, _found long")
    call = F.col("_calls") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    taken = placed.join(F.broadcast(before), "_part").withColumn("call", call).where(F.col("call") <= last)
    inside = F.count_if("hit").over(Window.partitionBy("_part").orderBy("_row"))
    return taken.withColumn("hits", F.col("_found") + inside).drop("_order", "_part", "_row", "_calls", "_found")
