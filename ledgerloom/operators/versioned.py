"""Tables that change by commits: a manifest per version, put only if nobody has put it before.

A version names, for each table and bucket of its key, the folder that holds the rows. A commit
writes new folders for the buckets that it changes and then puts the next manifest; of two
writers that started from the same version one puts it, and the other is told so and nothing of
it is seen. Readers take the newest manifest, so a change of several tables is seen as one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer has committed first."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content unless it exists; true for the one writer who did."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = store.create(draft, True)
    out.write(text.encode())
    out.close()
    try:
        if store.getUri().getScheme() == "file":
            try:  # a link is made by one writer only
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        if store.exists(target):
            return False
        return store.rename(draft, target)  # on the stores that Spark's own logs rely on, it fails where the target exists
    finally:
        if store.exists(draft):
            store.delete(draft, False)


class Store:
    """Versioned tables below a folder that all executors share; ``keys`` names each table's bucket column."""

    def __init__(self, spark: SparkSession, folder: str, keys: Mapping[str, str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, dict(keys), buckets

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_commits")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        return store, path

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        store, path = self._files()
        names = [f.getPath().getName() for f in store.listStatus(path)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        # a whole small file; one row
        return json.loads(self.spark.read.text(f"{self.folder}/_commits/{version:012d}.json", wholetext=True).first()[0])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table as of a version."""
        found = self.manifest(version)[name]
        folders = sorted(set(found["buckets"].values()))
        schema = T.StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, name: str) -> Column:
        """The bucket of a table's row."""
        return F.pmod(F.xxhash64(self.keys[name]), F.lit(self.buckets)).cast("int")

    def commit(self, base: int, changes: Mapping[str, DataFrame], touched: Mapping[str, list[int]] | None = None) -> int:
        """Make version ``base + 1`` with new rows for tables, or for their ``touched`` buckets only; refuse it if it exists."""
        now = {k: dict(v, buckets=dict(v["buckets"])) for k, v in self.manifest(base).items()}
        for name, rows in changes.items():
            folder = f"{self.folder}/{name}/{uuid.uuid4().hex}"
            rows.withColumn("_bucket", self.bucket(name)).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            made = {str(r[0]) for r in self.spark.read.parquet(folder).select("_bucket").distinct().collect()} if not self._empty(folder) else set()
            kept = now.get(name, {"buckets": {}})["buckets"]
            gone = set(map(str, touched[name])) if touched and name in touched else set(kept)
            buckets = {b: f for b, f in kept.items() if b not in gone} | {b: f"{folder}/_bucket={b}" for b in made}
            now[name] = {"schema": now[name]["schema"] if name in now else rows.schema.jsonValue(), "buckets": buckets}
        store, path = self._files()
        if not put_if_absent(self.spark, f"{path.toString()}/{base + 1:012d}.json", json.dumps(now)):
            raise Conflict(f"version {base + 1} is there already")
        return base + 1

    def _empty(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return not any(f.getPath().getName().startswith("_bucket=") for f in store.listStatus(path))

    def _parts(self, name: str, base: int, where: Column) -> tuple[DataFrame, list[int]]:
        """The rows of the buckets that hold a row for which ``where`` is true, and those buckets."""
        rows = self.table(name, base).withColumn("_bucket", self.bucket(name))
        hit = [r[0] for r in rows.where(where).select("_bucket").distinct().collect()]  # at most as many as there are buckets
        return rows.where(F.col("_bucket").isin(hit) if hit else F.lit(False)).drop("_bucket"), hit

    def update(self, name: str, where: Column, values: Mapping[str, Column], base: int | None = None) -> int:
        """Set columns of the rows for which ``where`` is true, in one commit; how many there were (0: no commit).

        A condition on the state that a step needs, with the number as the answer, is a
        compare-and-swap: whoever comes second finds no row, or a :class:`Conflict` if both read
        the same version.
        """
        base = self.version() if base is None else base
        rows, hit = self._parts(name, base, where)
        if not hit:
            return 0
        changed = rows.where(where).count()
        new = rows.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})
        self.commit(base, {name: new}, {name: hit})
        return changed

    def delete_cascade(self, roots: DataFrame, links: list[tuple[str, str, str | None, str | None]], base: int | None = None) -> dict[str, int]:
        """Delete rows of several tables in one commit; how many of each.

        ``links`` goes from the first table to the last: (table, column, parent table, parent column). The first
        one's column is compared with the only column of ``roots``, the others' with the parent's deleted rows.
        """
        base = self.version() if base is None else base
        gone: dict[str, DataFrame] = {}
        changes, touched, counts = {}, {}, {}
        for name, column, parent, parent_column in links:
            ids = roots.toDF("_id") if parent is None else gone[parent].select(F.col(parent_column).alias("_id"))
            ids = ids.where("_id is not null").distinct()
            rows = self.table(name, base)
            gone[name] = rows.join(ids, rows[column] == F.col("_id"), "left_semi")
            marked = gone[name].select(self.bucket(name).alias("_bucket")).groupBy("_bucket").count().collect()  # one row per bucket
            counts[name] = sum(r[1] for r in marked)
            if marked:
                touched[name] = [r[0] for r in marked]
                part = rows.where(self.bucket(name).isin(touched[name]))
                changes[name] = part.join(ids, part[column] == F.col("_id"), "left_anti")
        if changes:
            self.commit(base, changes, touched)
        return counts

    def forget(self, versions: int) -> None:
        """Remove the manifests before the newest ``versions`` and the folders that no later one names."""
        newest = self.version()
        store, path = self._files()
        old = sorted(int(f.getPath().getName().removesuffix(".json")) for f in store.listStatus(path) if f.getPath().getName().endswith(".json"))
        old = [v for v in old if v <= newest - versions]
        if not old:
            return
        kept = {f for v in range(newest - versions + 1, newest + 1) for t in self.manifest(v).values() for f in t["buckets"].values()}
        gone = {f for v in old for t in self.manifest(v).values() for f in t["buckets"].values()} - kept
        for name in [*gone, *(f"{path.toString()}/{v:012d}.json" for v in old)]:
            store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(name), True)
