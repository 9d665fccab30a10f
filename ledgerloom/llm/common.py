"""Small helpers that several operators share: checkpoints, ranks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_SALTS = 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a session in local mode, as in tests, gets a temporary folder where that is unset;
    on a cluster it is an error, since executors don't share such a folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def little_kept(spark: SparkSession, batch_rows: int = 1024) -> Iterator[None]:
    """Inside, a job's shuffle files go as soon as it ends, and Python gets ``batch_rows`` rows at a time.

    For operators that checkpoint or write what a job has made: the shuffles before that are
    never read again, but would stay on disk until the driver happens to collect its garbage.
    The session's own settings hold again afterwards.
    """
    now = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}
    before = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drawn(df: DataFrame, rows: int, most: int, *keys: str, seed: int = 0) -> DataFrame:
    """About ``most`` of the ``rows`` rows of ``df``, the same ones at each run: those whose hash of ``keys`` is small.

    Nothing is sorted, and each partition gives its share only. Many equal rows fall in or out
    together, so what is brought to the driver is also limited to four times ``most``.
    """
    share = min(1.0, most / max(rows, 1))
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))).limit(4 * most)


def with_rank(df: DataFrame, *keys: str, rank: str = "rank", partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Add the gapless position (from 0) of each row in the order of ``keys``.

    The rows are range-partitioned and sorted; a row's place is its place in its partition
    plus the sizes of the partitions before it. Only one number per partition is brought
    together. ``keys`` should be unique per row, or equal rows get positions in any order.
    With ``weight``, ``<rank>_start`` has the sum of that column over all earlier rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(k) for k in keys]
    placed = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    # the low 33 bits count the rows of a partition, the high ones hold its number
    mono = F.monotonically_increasing_id()
    placed = checkpointed(
        placed.withColumn("_mono", mono)
        .withColumn("_pid", F.shiftright("_mono", 33))
        .withColumn("_pos", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mono")
    )
    sums = [F.count(F.lit(1)).alias("_rows")]
    if weight:
        sums.append(F.sum(weight).alias("_weight"))
    parts = placed.groupBy("_pid").agg(*sums).collect()  # one row per partition
    start, heavy, table = 0, 0, []
    for r in sorted(parts):
        table.append((r["_pid"], start, heavy))
        start += r["_rows"]
        heavy += (r["_weight"] or 0) if weight else 0
    before = spark.createDataFrame(table, "_pid long, _before long, _heavy long")
    out = placed.join(F.broadcast(before), "_pid").withColumn(rank, F.col("_before") + F.col("_pos"))
    if weight:
        out = out.mapInPandas(_running(weight, f"{rank}_start"), out.withColumn(f"{rank}_start", F.lit(0).cast("long")).schema)
    return out.drop("_pid", "_pos", "_before", "_heavy")


def _running(weight: str, name: str):
    """Running sums inside each sorted partition; a partition is read in its order by one task."""

    def run(batches):
        done = None
        for pdf in batches:
            if len(pdf):
                if done is None:
                    done = int(pdf["_heavy"].iloc[0])
                w = pdf[weight].to_numpy("int64")
                ends = w.cumsum() + done
                pdf[name] = ends - w
                done = int(ends[-1])
            else:
                pdf[name] = pdf[weight]
            yield pdf

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for each node of ``edges``; component is the smallest node reachable.

    Alternates large-star and small-star rounds until the edges no longer change. Each round
    re-points edges at the smallest neighbour, aggregates by a minimum (combined before the
    shuffle) and is cut by a checkpoint. No edge or component is brought to the driver.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    before = None
    for _ in range(max_rounds):
        # large star: each neighbour larger than a node is tied to the node's smallest neighbour;
        # by (node, salt), since a node in the middle of a large star has very many neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("s", F.pmod(F.xxhash64("v"), F.lit(_SALTS)).cast("int"))
        low = both.groupBy("u", "s").agg(F.min("v").alias("m")).select("u", "s", F.least("u", F.min("m").over(Window.partitionBy("u"))).alias("m"))
        e = both.where("v > u").join(low, ["u", "s"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of a node are tied to the smallest of them
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        e = checkpointed(e)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.union(roots)


def joined_small(df: DataFrame, small: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """Add the columns of ``small``, which has one row per value of ``key`` (null is a value), to the rows of ``df``.

    The rows of ``small`` are counted: up to ``most`` of them are broadcast. Beyond that the join goes by (key, salt) with
    each row of ``small`` copied to every salt, so that a key with very many rows is spread.
    """
    small = small.withColumnRenamed(key, "_joined")
    if small.limit(most + 1).count() <= most:
        return df.join(F.broadcast(small), F.col(key).eqNullSafe(F.col("_joined")), "left").drop("_joined")
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = df.withColumn("_salt", (F.monotonically_increasing_id() % _SALTS).cast("int"))
    return salted.join(copies, F.col(key).eqNullSafe(F.col("_joined")) & (F.col("_salt") == F.col("_copy")), "left").drop("_joined", "_salt", "_copy")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``df`` written as Parquet to the shared folder and read back, so that columns can be pruned; and where they are."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
