"""Comparing the members of buckets without bringing a large bucket together.

A bucket of more than ``block`` rows is cut into parts by hash; every pair of parts is a
block of its own, so that each pair of rows meets in exactly one block of the bucket and no
task gets more than two parts. Blocks are compared with numpy inside tasks, and tell what
belongs together by one edge per row, never by all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

SALTS = 16


def with_bucket_size(rows: DataFrame, keys: list[str], row_id: str, size: str = "bucket_size") -> DataFrame:
    """Add the number of rows of each row's bucket; buckets of one row are left out."""
    return with_group_count(rows, keys, row_id, size).where(F.col(size) > 1)


def with_group_count(rows: DataFrame, keys: list[str], row_id: str, size: str) -> DataFrame:
    """Add the number of rows of each row's group.

    Counted and joined per (group, salt), so that a group with many rows is spread.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id, F.lit(5)), F.lit(SALTS)).cast("int"))
    counts = rows.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn(size, F.sum("_n").over(Window.partitionBy(*keys))).drop("_n")
    return rows.join(counts, [*keys, "_salt"]).drop("_salt")


def in_blocks(rows: DataFrame, row_id: str, block: int, size: str = "bucket_size") -> DataFrame:
    """Replace ``size`` by lo, hi (the block of the bucket) and own (the row's part, lo or hi)."""
    parts = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(row_id, F.lit(9)), parts).cast("int")
    out = rows.withColumn("own", own).withColumn("_j", F.explode(F.sequence(F.lit(0), parts - 1)))
    return out.withColumn("lo", F.least("own", "_j")).withColumn("hi", F.greatest("own", "_j")).drop("_j", size)


def map_blocks(rows: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """Run ``work`` on the rows of each block (keys, lo, hi); many small blocks share one task and one batch."""
    keys = [*keys, "lo", "hi"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys)

    def run(batches):
        for pdf in _whole_groups(batches, keys):
            out: list[tuple] = []
            for part in _split(pdf, keys):
                out += work(part)
            yield pd.DataFrame(out, columns=columns)

    return dealt.mapInPandas(run, schema)


def _bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups begin in sorted rows, and the end."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        x = pdf[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.r_[np.flatnonzero(new), len(pdf)]


def _split(pdf: pd.DataFrame, keys: list[str]) -> Iterator[pd.DataFrame]:
    at = _bounds(pdf, keys)
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s > 1:
            yield pdf.iloc[s:e]


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches re-cut so that no group is split; holds back the last group of each batch."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        if held and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys):
            last = _bounds(pdf, keys)
            if len(last) == 2:  # one group, which goes on
                held.append(pdf)
                continue
            held.append(pdf.iloc[: last[1]])
            pdf = pdf.iloc[last[1] :]
        if held:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        last = _bounds(pdf, keys)[-2]
        if last:
            yield pdf.iloc[:last]
        held = [pdf.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _stars(near: Callable[[pd.DataFrame], Callable[[int, np.ndarray], np.ndarray]], row: list[str], keys: list[str]):
    """Star edges among the rows of a block: each row of the right side against those of the left side.

    With ``keys``, the right side is one row, and all rows of the left side that are near to it
    are told, with the keys and the rest of ``row``.
    """

    def work(part: pd.DataFrame) -> list[tuple]:
        if len(row) > 1 and len(set(part[row[0]])) < len(part):
            part = part.drop_duplicates(subset=[*row, "left", "right"])
        ids = part[row[0]].to_numpy()
        left, right = part["left"].to_numpy(), part["right"].to_numpy()
        if len(ids) < 2 or not left.any() or not right.any():
            return []
        test, group = near(part), np.arange(len(ids))
        all_pairs = bool(left.all() and right.all())
        lefts = np.flatnonzero(left)
        for i in np.flatnonzero(right):
            others = lefts[np.searchsorted(lefts, i + 1) :] if all_pairs else lefts
            # what is tied already needn't be compared
            others = others[group[others] != group[i]]
            if len(others):
                hit = others[test(int(i), others)]
                if len(hit):
                    joined = np.isin(group, group[np.r_[i, hit]])
                    group[joined] = group[joined].min()
        if keys:
            middle = int(np.flatnonzero(right)[0])
            tied = left & (group == group[middle])
            more = [[part[k].iloc[0]] * int(tied.sum()) for k in keys] + [part[k].to_numpy()[tied].tolist() for k in row[1:]]
            return list(zip(ids[tied].tolist(), [int(ids[middle])] * int(tied.sum()), *more, strict=True))
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, group, ids)
        roots = low[group]
        moved = roots != ids
        return list(zip(ids[moved].tolist(), roots[moved].tolist(), strict=True))

    return work


def edges_in_groups(rows: DataFrame, keys: list[str], row: list[str], near, block: int, size: str = "bucket_size") -> DataFrame:
    """Distinct edges (a, b) whose components are those of all near pairs of each group.

    ``rows`` has the keys, the columns ``row`` that name a row once in a group (the first one is
    the id that edges tell of), the group's size and what ``near`` compares. It is read several
    times, so it should be written. Groups of up to ``block`` rows are compared pair by pair in
    one task. In a larger one all rows are first compared with one middle row, in blocks; only
    rows that aren't near to it are then compared with all rows of the group, again in blocks.
    A group of copies takes linear work so.
    """
    id_, zero, yes, no = row[0], F.lit(0), F.lit(True), F.lit(False)
    types = dict(rows.dtypes)
    more = [c for c in rows.columns if c not in {*keys, *row, size}]

    def compared(parts: DataFrame, with_keys: bool) -> DataFrame:
        told = [*keys, *row[1:]] if with_keys else []
        schema = ", ".join(["a long", "b long", *(f"{k} {types[k]}" for k in told)])
        return map_blocks(parts, keys, _stars(near, row, keys if with_keys else []), ["a", "b", *told], schema)

    whole = rows.where(F.col(size) <= block).drop(size)
    edges = compared(whole.select("*", zero.alias("lo"), zero.alias("hi"), yes.alias("left"), yes.alias("right")), False)
    edges = checkpointed(edges.distinct())
    heavy = rows.where(F.col(size) > block)
    large = heavy.select(*keys, *row, size)
    if large.isEmpty():
        return edges
    parts = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(id_, F.lit(9)), parts).cast("int")
    # with what is compared, so that it is brought together for one row a group only
    middle = heavy.groupBy(*keys).agg(F.min_by(F.struct(*row, size, *more), F.struct(*row)).alias("m")).select(*keys, "m.*")
    members = heavy.select(*keys, *row, own.alias("lo"), zero.alias("hi"), yes.alias("left"), no.alias("right"), *more)
    middles = middle.select(*keys, *row, F.explode(F.sequence(zero, parts - 1)).alias("lo"), zero.alias("hi"), no.alias("left"), yes.alias("right"), *more)
    star = checkpointed(compared(members.unionByName(middles), True))
    # rows that the middle one isn't near to
    named = large.groupBy(*keys).agg(F.min(F.struct(*row)).alias("m")).select(*keys, "m.*")
    known = star.select(*keys, F.col("a").alias(id_), *row[1:]).unionByName(named).distinct()
    apart = checkpointed(large.join(known, [*keys, *row], "left_anti"))
    out = edges.unionByName(star.where("a <> b").select("a", "b"))
    if not apart.isEmpty():
        apart = with_group_count(apart, keys, id_, "open")
        counts = apart.groupBy(*keys).agg(F.max("open").alias("open"))
        salted = counts.withColumn("_salt", F.explode(F.sequence(zero, F.lit(SALTS - 1))))
        slices = F.ceil(F.col("open") / block).cast("int")
        lefts = large.withColumn("_salt", F.pmod(F.xxhash64(id_, F.lit(5)), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"])
        lefts = lefts.select(*keys, *row, own.alias("lo"), F.explode(F.sequence(zero, slices - 1)).alias("hi"), yes.alias("left"), no.alias("right"))
        slot = F.pmod(F.xxhash64(id_, F.lit(13)), slices).cast("int")
        rights = apart.select(*keys, *row, F.explode(F.sequence(zero, parts - 1)).alias("lo"), slot.alias("hi"), no.alias("left"), yes.alias("right"))
        out = out.unionByName(compared(lefts.unionByName(rights).join(heavy.drop(size), [*keys, *row]), False))
    return checkpointed(out.distinct())


def smallest_reachable(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``ids``, the smallest id reachable over the links (positions a, b)."""
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    low = place.copy()
    if len(a):
        while True:
            before = low.copy()
            np.minimum.at(low, a, before[b])
            np.minimum.at(low, b, low[a])
            low = low[by_id[low]]  # jump to the label of one's label
            if (low == before).all():
                break
    return ids[by_id[low]]
