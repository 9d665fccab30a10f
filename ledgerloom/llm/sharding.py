"""Balanced label propagation over linked documents, with DataFrame functions only.

Documents with equal texts are linked. Each document starts in the shard that its place in
a hashed order gives; then rounds of joins move linked documents to the shard where most of
their group is, as far as that shard has room. A group that is larger than half a shard is
propagated in parts. Moves are drawn by hash with the probability room / demand, so no
shard's queue is ever brought together. In the last round every group, or part of one, goes
as a whole to the shard where most of it is, and a distributed ranking turns the near-equal
loads into exact quotas: numbers of rows at most one apart (law ``rows``). What lies beyond a
quota fills the shards with room, group by group: unlinked rows give way first, and a group is
split only where it lies across a quota, at most twice a shard.

The rounds work on counts per (group part, shard), at most ``SALTS`` x shards rows for a
group however many rows it has; documents are joined on (group, salt), which splits hot
groups.

Defined results: a null text has size 8, checksum 0 and no links; all empty texts are one
group; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, with_rank

SHARDS = 24
SALTS = 64
ROUNDS = 8
RESERVE = 0.03


def _quota(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def _by_shard(values: list[float], column: str = "shard"):
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(column).cast("int") + 1)


def _slice_of(position, quotas: list[int]):
    """The shard of a place when the shards take their quotas one after the other."""
    n, shards = sum(quotas), len(quotas)
    small, large = n // shards, n % shards
    head = large * (small + 1)
    return F.when(position < head, F.floor(position / (small + 1))).otherwise(large + F.floor((position - head) / max(small, 1))).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, reserve: float = RESERVE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and group_size of every row."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(F.col("text").cast("binary"))).alias("g"),
        F.monotonically_increasing_id().alias("uid"),
    )
    base = base.withColumn("f", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).withColumn("turn", F.xxhash64("uid", F.lit(1)))
    placed = with_rank(base, "turn", "uid", rank="at")
    placed = checkpointed(placed.drop("turn"))
    n = placed.count()
    if not n:
        return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.lit(0).alias("shard"), F.col("at").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("at").alias("group_size"))
    quotas = _quota(n, shards)
    placed = placed.withColumn("shard", _slice_of(F.col("at"), quotas)).drop("at")

    # counts per (group, salt, shard); groups of one row have no links
    fine = placed.where("g is not null").groupBy("g", "f", "shard").agg(F.count(F.lit(1)).alias("rows"))
    fine = fine.withColumn("group_size", F.sum("rows").over(Window.partitionBy("g"))).where("group_size > 1")
    parts = F.least(F.ceil(F.col("group_size") / max(max(quotas) / 2, 1)), F.lit(SALTS)).cast("int")
    fine = checkpointed(fine.withColumn("sub", F.col("f") % parts))
    units = fine.groupBy("g", "sub", "shard").agg(F.sum("rows").alias("rows"))
    # unlinked rows give way at the end, so that a shard has room for linked ones up to its quota
    loads = [0.0] * shards
    for r in units.groupBy("shard").agg(F.sum("rows").alias("rows")).collect():
        loads[r["shard"]] += r["rows"]
    caps = [q * (1 - reserve) for q in quotas]
    for turn in range(rounds):
        # towards the neighbours: where most of a unit is, ties to the smaller shard
        most = units.groupBy("g", "sub").agg(
            F.sum("rows").alias("total"), F.max_by(F.struct("shard", "rows"), F.struct("rows", -F.col("shard"))).alias("best"), F.count(F.lit(1)).alias("spread")
        )
        wish = units.join(most.where("spread > 1"), ["g", "sub"], "left").select(
            "g", "sub", "shard", "rows", F.col("best.shard").alias("to"), "total"
        )
        moving = wish.where("to is not null and shard <> to")
        flows = moving.groupBy("shard", "to").agg(F.sum("rows").alias("rows")).collect()  # shards x shards at most
        if not flows:
            break
        wanted, leaving = [0.0] * shards, [0.0] * shards
        for r in flows:
            wanted[r["to"]] += r["rows"]
            leaving[r["shard"]] += r["rows"]
        share = [min(1.0, max(0.0, caps[s] - loads[s] + leaving[s] / 2) / wanted[s]) if wanted[s] else 0.0 for s in range(shards)]
        draw = F.pmod(F.xxhash64("g", "sub", F.lit(turn)), F.lit(1_000_000)) / 1_000_000
        goes = F.col("to").isNotNull() & (draw < _by_shard(share, "to"))
        units = wish.select("g", "sub", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), "rows")
        units = checkpointed(units.groupBy("g", "sub", "shard").agg(F.sum("rows").alias("rows")))
        now = wish.select("shard", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("at"), "rows").where("shard <> at")
        for r in now.groupBy("shard", "at").agg(F.sum("rows").alias("rows")).collect():
            loads[r["shard"]] -= r["rows"]
            loads[r["at"]] += r["rows"]

    # a unit that hasn't come together goes as a whole to where most of it is; in the order below its
    # rows follow each other, so only a unit across a quota is split
    settled = units.groupBy("g", "sub").agg(F.max_by("shard", F.struct("rows", -F.col("shard"))).alias("unit_shard"))
    final = fine.select("g", "f", "sub", "group_size").distinct().join(settled, ["g", "sub"]).select("g", "f", "group_size", "unit_shard")
    moved = placed.join(final, ["g", "f"], "left").select(
        "uid", "doc_id", "size", "text_crc32", F.coalesce("unit_shard", "shard").alias("shard"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("unit_shard").isNotNull(), 0).otherwise(1).alias("gives_way"),
        (-F.coalesce("group_size", F.lit(1))).alias("smaller"), F.coalesce(F.xxhash64("g"), F.lit(0)).alias("near"),
    )
    # larger groups first, so that those across a quota are small ones
    ranked = checkpointed(with_rank(moved, "shard", "gives_way", "smaller", "near", "uid", rank="at"))

    # exact quotas: what lies beyond a shard's quota fills the shards that have room, in order
    load = {r["shard"]: r["count"] for r in ranked.groupBy("shard").count().collect()}
    first, room, at, free = [], [], 0, 0
    for s in range(shards):
        first.append(at)
        room.append(free)
        at += load.get(s, 0)
        free += max(0, quotas[s] - load.get(s, 0))
    slot = (F.col("at") - _by_shard(first)).cast("long")
    ranked = ranked.withColumn("slot", slot)
    stay = ranked.where(F.col("slot") < _by_shard(quotas))
    over = with_rank(ranked.where(F.col("slot") >= _by_shard(quotas)).drop("at", "slot", "shard"), "smaller", "near", "uid", rank="at")
    targets = [s for s in range(shards) if load.get(s, 0) < quotas[s]]
    to = F.lit(0)
    for s in targets:
        to = F.when(F.col("at") >= room[s], F.lit(s)).otherwise(to)
    over = over.withColumn("shard", to.cast("int")).withColumn(
        "slot", (F.col("at") - _by_shard(room) + _by_shard([load.get(s, 0) for s in range(shards)])).cast("long")
    )
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size"]
    return stay.select(*columns).unionByName(over.select(*columns))
