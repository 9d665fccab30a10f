"""Tables whose files were written under several schemas, read as one."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workbook import store_of

#: each kind and the kinds that hold all its values
_WIDER = {
    "tinyint": ["smallint", "int", "bigint", "double"], "smallint": ["int", "bigint", "double"], "int": ["bigint", "double"], "bigint": [],
    "float": ["double"], "double": [], "date": ["timestamp_ntz"], "boolean": [], "string": [],
}


class Incompatible(ValueError):
    """A column's kinds have no kind that holds the values of all of them, or a declared kind is too narrow."""


def holds(wide: str, narrow: str) -> bool:
    if wide == narrow or wide in _WIDER.get(narrow, []):
        return True
    if wide.startswith("decimal") and (narrow.startswith("decimal") or narrow in _DIGITS):
        return _digits(wide)[0] >= _digits(narrow)[0] and _digits(wide)[1] >= _digits(narrow)[1]
    return False


_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def _digits(kind: str) -> tuple[int, int]:
    """Digits before and behind the point."""
    if kind in _DIGITS:
        return _DIGITS[kind], 0
    p, s = map(int, kind[kind.index("(") + 1 : -1].split(","))
    return p - s, s


def wider(a: str, b: str, column: str) -> str:
    """The least kind that holds the values of both."""
    for one, other in ((a, b), (b, a)):
        if holds(one, other):
            return one
    if all(k.startswith("decimal") or k in _DIGITS for k in (a, b)):
        (p, s), (q, t) = _digits(a), _digits(b)
        if max(p, q) + max(s, t) <= 38:
            return f"decimal({max(p, q) + max(s, t)},{max(s, t)})"
    common = [k for k in _WIDER.get(a, []) if k in _WIDER.get(b, [])]
    if not common:
        raise Incompatible(f"{column}: {a} and {b}")
    return common[0]


def file_schemas(spark: SparkSession, folder: str) -> list[tuple[T.StructType, list[str]]]:
    """The schemas that the Parquet files below a folder have, and their files; footers are read by the executors."""

    def footers(batches):
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                store, place = store_of(path)
                with store.open_input_file(place) as f:
                    meta = pq.read_schema(f).metadata or {}
                out.append((meta.get(b"org.apache.spark.sql.parquet.row.metadata", b"").decode(), path))
            yield pd.DataFrame(out, columns=["schema", "path"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    rows = files.mapInPandas(footers, "schema string, path string").groupBy("schema").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()  # one row per schema
    out = []
    for r in rows:
        schema = T.StructType.fromJson(json.loads(r["schema"])) if r["schema"] else spark.read.parquet(r["paths"][0]).schema
        out.append((schema, r["paths"]))
    return sorted(out, key=lambda x: x[1][0])


def reconciled_schema(schemas: list[T.StructType], declared: Mapping[str, str] | None = None) -> dict[str, str]:
    """Columns in the order in which they appear, with kinds that hold all values; a declared kind that is narrower is refused."""
    out: dict[str, str] = {}
    for schema in schemas:
        for f in schema.fields:
            kind = f.dataType.simpleString()
            out[f.name] = wider(out[f.name], kind, f.name) if f.name in out else kind
    for name, kind in (declared or {}).items():
        if name in out and not holds(kind, out[name]):
            raise Incompatible(f"{name}: files have {out[name]}, {kind} is declared")
        out[name] = kind
    return out


def read_generations(spark: SparkSession, folder: str, declared: Mapping[str, str] | None = None, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """All files below a folder as one table.

    Columns that a file hasn't get their default, or null; kinds are widened; a column whose
    values no kind can hold, or whose declared kind is too narrow, is refused before rows are read.
    Each generation is one scan, so column pruning and filters reach the files.
    """
    found = file_schemas(spark, folder)
    kinds = reconciled_schema([s for s, _ in found], declared)
    out = None
    for schema, paths in found:
        have = set(schema.fieldNames())
        rows = spark.read.schema(schema).parquet(*paths)
        columns = [(F.col(f"`{c}`") if c in have else F.lit((defaults or {}).get(c))).cast(k).alias(c) for c, k in kinds.items()]
        out = rows.select(*columns) if out is None else out.unionByName(rows.select(*columns))
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in kinds.items()))
