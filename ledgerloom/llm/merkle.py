"""Merkle manifest of a table by superblock reduction.

Each row is a leaf; the leaves of a group (a source) stand in the order of a key, and every
``FANOUT`` consecutive nodes become one until one is left, the group's subroot. The subroots
in the order of their groups are reduced likewise to the root.

The index of a node by ``FANOUT ** LEVELS`` names its bucket. One ``applyInPandas`` task takes
whole buckets and collapses up to ``LEVELS`` levels of them at once; the buckets' roots are the
nodes of the next round, so a billion leaves take three rounds. Buckets that begin in the same
stretch of the global order share a task: it holds at most two buckets' worth of nodes, however
many tiny groups there are and however large one group is. Proofs come back downwards: a
bucket's proof, known from the rounds above it, is appended to the lower proof of each of its
nodes, which its task builds again. No proof is kept for more than one round.

Defined results: a null group is a group of its own and comes first, as do null keys within a
group; rows that repeat a key stand in the order of their digests; a null in any column is
hashed as ``-``, an empty text as ``0:``; an empty table gives no rows. Columns that aren't
named are neither read nor hashed, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, joined_small, with_rank

FANOUT = 16
#: levels that one round collapses: buckets of FANOUT ** LEVELS nodes
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: one in so many rows is tampered with in the report
TAMPERED = 5
SIZE = 32  # bytes of a digest


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(columns: Sequence[Column]) -> Column:
    """The digest of a row: each value as its length in UTF-8 bytes, a colon and the value, or ``-`` for null."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def depth(nodes: int, fanout: int = FANOUT) -> int:
    """Levels above ``nodes`` nodes until one is left."""
    out = 0
    while nodes > 1:
        nodes, out = -(-nodes // fanout), out + 1
    return out


def collapsed(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes and ``levels`` levels above them."""
    rows = [nodes]
    for _ in range(levels):
        below = rows[-1]
        rows.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return rows


def lower_proofs(rows: list[list[str]], fanout: int = FANOUT) -> list[bytes]:
    """For each node of the lowest row the digests beside its path, up to the row below the top."""
    above = [b""] * len(rows[-1])
    for row in reversed(rows[:-1]):
        raw = bytes.fromhex("".join(row))
        here = []
        for i in range(len(row)):
            run = i // fanout * fanout
            end = min(run + fanout, len(row))
            here.append(raw[SIZE * run : SIZE * i] + raw[SIZE * (i + 1) : SIZE * end] + above[i // fanout])
        above = here
    return above


def folded(node: str, proof: bytes, places: Sequence[tuple[int, int]], fanout: int = FANOUT) -> str:
    """The root that a node and its proof lead to; ``places`` has the node's index and the number of nodes, tree by tree upwards."""
    beside = [proof[i : i + SIZE].hex() for i in range(0, len(proof), SIZE)]
    at = 0
    for index, count in places:
        while count > 1:
            run = index // fanout * fanout
            others = min(fanout, count - run) - 1
            split = at + index - run
            node = digest("".join(beside[at:split]) + node + "".join(beside[split : at + others]))
            at += others
            index, count = index // fanout, -(-count // fanout)
    if at != len(beside):
        raise ValueError("the proof doesn't fit the place")
    return node


class Reduction:
    """One forest of trees, a tree for each ``tree``: rows (tree, idx, n, first, digest) are its lowest nodes.

    ``first`` is the place of a tree's first node when all trees stand one behind the other;
    ``most`` the largest ``n``.
    """

    def __init__(self, nodes: DataFrame, most: int, fanout: int = FANOUT, levels: int = LEVELS):
        self.fanout, self.levels, self.span = fanout, levels, fanout**levels
        self.rounds: list[DataFrame] = []  # the nodes of each round with their task
        self.tops: list[DataFrame] = []  # what the buckets of each round became
        while True:
            # buckets that begin in the same stretch of `span` places share a task
            nodes = nodes.withColumn("unit", F.floor(F.col("first") / self.span) + F.floor(F.col("idx") / self.span))
            made = nodes.select("unit", "tree", "idx", "n", "first", "digest").groupBy("unit").applyInPandas(self._up(), "unit long, tree long, idx long, n long, first long, digest string")
            self.rounds.append(nodes)
            self.tops.append(checkpointed(made))
            most = -(-most // self.span)
            if most <= 1:
                break
            nodes = self.tops[-1].where("n > 1").drop("unit")

    def roots(self) -> DataFrame:
        """Rows (tree, digest)."""
        out = None
        for top in self.tops:
            ended = top.where("n = 1").select("tree", "digest")
            out = ended if out is None else out.union(ended)
        return out

    def proofs(self, roots: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
        """The lowest nodes with ``carried`` columns (strings) and ``proof``, which ends with the root's own proof from ``roots`` (tree, proof)."""
        found = None
        for nodes, top in zip(reversed(self.rounds), reversed(self.tops)):
            known = top.where("n = 1").join(roots, "tree").select("unit", "tree", "idx", "proof")
            if found is not None:
                over = top.where("n > 1").select("unit", "tree", "idx").join(found, ["tree", "idx"])
                known = known.unionByName(over.select("unit", "tree", "idx", "proof"))
            extra = [c for c in carried if nodes is self.rounds[0]]
            kept = ["unit", "tree", "idx", "n", "digest", *extra]
            kinds = "tree long, idx long, n long, digest string, proof binary" + "".join(f", `{c}` string" for c in extra)
            found = nodes.select(*kept).groupBy("unit").cogroup(known.groupBy("unit")).applyInPandas(self._down(extra), kinds)
            if nodes is not self.rounds[0]:
                found = checkpointed(found.select("tree", "idx", "proof"))
        return found

    def _buckets(self):
        fanout, levels, span = self.fanout, self.levels, self.span

        def buckets(pdf: pd.DataFrame):
            """(tree, bucket, nodes of the tree, levels to collapse, rows) of each bucket; the rows in order."""
            pdf = pdf.sort_values(["tree", "idx"], kind="stable")
            for (tree, bucket), rows in pdf.groupby([pdf["tree"], pdf["idx"] // span], sort=True):
                n = int(rows["n"].iloc[0])
                yield int(tree), int(bucket), n, min(levels, depth(n, fanout)), rows

        return buckets

    def _up(self):
        buckets, fanout, span = self._buckets(), self.fanout, self.span

        def up(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for tree, bucket, n, levels, rows in buckets(pdf):
                top = collapsed(rows["digest"].tolist(), levels, fanout)[-1][0]
                # trees keep apart: of the places before a tree, every `span` give one, and every tree one more
                out.append((int(rows["unit"].iloc[0]), tree, bucket, -(-n // span), int(rows["first"].iloc[0]) // span + tree, top))
            return pd.DataFrame(out, columns=["unit", "tree", "idx", "n", "first", "digest"])

        return up

    def _down(self, carried: list[str]):
        buckets, fanout = self._buckets(), self.fanout
        names = ["tree", "idx", "n", "digest", "proof", *carried]

        def down(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            over = dict(zip(zip(known["tree"], known["idx"]), known["proof"]))
            out = []
            for tree, bucket, _, levels, rows in buckets(pdf):
                lower = lower_proofs(collapsed(rows["digest"].tolist(), levels, fanout), fanout)
                upper = bytes(over[tree, bucket])
                out.append(rows.assign(proof=[p + upper for p in lower])[names])
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

        return down


def manifest(rows: DataFrame, group: str, key: str, leaf: Column, carried: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Key, ``carried`` columns (strings), leaf, place and number of leaves in the group (``place``, ``size``), of the group
    (``group_place``, ``groups``), ``subroot``, ``root`` and ``proof`` (binary: the digests beside the path, upwards)."""
    carried = carried or {}
    kind = rows.schema[key].dataType.simpleString()
    columns = [F.col(group).alias("_group"), F.col(key).alias("_order"), F.col(key).cast("string").alias("_key"), leaf.alias("digest")]
    leaves = checkpointed(rows.select(*columns, *[c.cast("string").alias(f"_c_{k}") for k, c in carried.items()]))
    placed = with_rank(leaves, "_group", "_order", "digest", rank="_at")
    placed = checkpointed(placed.drop("_order"))
    groups = with_rank(placed.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")), "_group", rank="tree")
    groups = checkpointed(groups)
    most, many = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    nodes = joined_small(placed, groups, "_group").withColumn("idx", F.col("_at") - F.col("first")).drop("_at", "_group")
    lower = Reduction(checkpointed(nodes), most or 0, fanout, levels)
    subroots = checkpointed(lower.roots())
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(many).cast("long").alias("n"), F.lit(0).cast("long").alias("first"), "digest")
    upper = Reduction(tops, many, fanout, levels)
    root = upper.roots().first()
    above = upper.proofs(rows.sparkSession.createDataFrame([(0, b"")], "tree long, proof binary")).select(F.col("idx").alias("tree"), "proof")
    above = checkpointed(above)
    names = ["_key", *[f"_c_{k}" for k in carried]]
    out = lower.proofs(above, names)
    out = joined_small(out, subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    return out.select(
        F.col("_key").cast(kind).alias(key),
        *[F.col(f"_c_{k}").alias(k) for k in carried],
        F.col("digest").alias("leaf"),
        F.col("idx").alias("place"),
        F.col("n").alias("size"),
        F.col("tree").alias("group_place"),
        F.lit(many).cast("long").alias("groups"),
        "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        "proof",
    )


def folded_roots(rows: DataFrame, node: str = "leaf", out: str = "folded_root", fanout: int = FANOUT) -> DataFrame:
    """Add the root that ``node`` and the row's proof lead to; a proof is checked row by row, without the other rows."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def fold(batches):
        for pdf in batches:
            ways = zip(pdf[node], pdf["proof"], pdf["place"], pdf["size"], pdf["group_place"], pdf["groups"])
            yield pdf.assign(**{out: [folded(x, bytes(p), ((a, n), (g, m)), fanout) for x, p, a, n, g, m in ways]})

    return rows.mapInPandas(fold, f"{kinds}, `{out}` string")


def tamper_report(docs: DataFrame) -> DataFrame:
    """Query op12: proofs of the untampered table, folded from rows some of which were tampered with.

    Rows whose key's checksum is divisible by ``TAMPERED`` have the letters A-Z of their text
    lower-cased; a text without such letters stays as it is, and so does its verdict.
    """
    columns = [F.col(c) for c in COLUMNS]
    changed = [F.translate(c, string.ascii_uppercase, string.ascii_lowercase) if name == "text" else c for name, c in zip(COLUMNS, columns)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    leaf = leaf_of(columns)
    rows = manifest(docs.select(*COLUMNS), "source", "doc_id", leaf, {"found": F.when(hit, leaf_of(changed))})
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumns({"found": F.coalesce("found", "leaf"), "doc_id": F.col("doc_id").cast("string")})
    rows = folded_roots(rows, "found")
    proof = F.sha2(F.lower(F.hex("proof")).cast("binary"), 256)
    return rows.select(F.col("doc_id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Both trees level by level; the fold climbs from each row's own digest and the digests beside its path.
SQL = r"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
        sha256(concat(head, coalesce(concat(octet_length(encode(text)), ':', text), '-'))) AS leaf,
        sha256(concat(head, coalesce(concat(octet_length(encode(lowered)), ':', lowered), '-'))) AS lowered_leaf,
        list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i:i]) AS BIGINT)),
            lambda c, b: list_reduce(range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)) AS crc
    FROM (
        SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
            concat(coalesce(concat(length(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(octet_length(encode(source)), ':', source), '-'),
                coalesce(concat(octet_length(encode(lang)), ':', lang), '-'), coalesce(concat(length(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head
        FROM documents
    )
), sub AS (
    SELECT source, 0 AS level, idx, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM sub WHERE n > 1
    GROUP BY source, level, idx // 16, n
), subroots AS (
    SELECT source, level AS top_level, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS groups FROM sub WHERE n = 1
), up AS (
    SELECT 0 AS level, place AS idx, groups AS n, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1
    GROUP BY level, idx // 16, n
), paths AS (
    SELECT l.doc_id, s.subroot, s.place, s.top_level, s.source, l.idx, l.leaf,
        CASE WHEN xor(l.crc, 4294967295) % 5 = 0 THEN l.lowered_leaf ELSE l.leaf END AS found
    FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
), beside AS (
    SELECT p.doc_id, b.level, string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < m.idx) AS before,
        string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > m.idx) AS after
    FROM paths p JOIN sub m ON m.source IS NOT DISTINCT FROM p.source AND m.n > 1 AND m.idx = p.idx // CAST(16 ** m.level AS BIGINT)
        JOIN sub b ON b.source IS NOT DISTINCT FROM m.source AND b.level = m.level AND b.idx // 16 = m.idx // 16
    GROUP BY p.doc_id, b.level
    UNION ALL
    SELECT p.doc_id, p.top_level + b.level, string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < m.idx),
        string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > m.idx)
    FROM paths p JOIN up m ON m.n > 1 AND m.idx = p.place // CAST(16 ** m.level AS BIGINT) JOIN up b ON b.level = m.level AND b.idx // 16 = m.idx // 16
    GROUP BY p.doc_id, p.top_level, b.level
), fold AS (
    SELECT doc_id, 0 AS level, found AS digest FROM paths
    UNION ALL
    SELECT f.doc_id, f.level + 1, sha256(concat(b.before, f.digest, b.after)) FROM fold f JOIN beside b ON b.doc_id = f.doc_id AND b.level = f.level
), proofs AS (
    SELECT doc_id, sha256(string_agg(concat(before, after), '' ORDER BY level)) AS proof_sha256 FROM beside GROUP BY doc_id
), ends AS (
    SELECT doc_id, arg_max(digest, level) AS folded_root FROM fold GROUP BY doc_id
)
SELECT p.doc_id, p.leaf, p.subroot, r.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.digest AS verified
FROM paths p JOIN (SELECT digest FROM up WHERE n = 1) r ON true JOIN ends e USING (doc_id) LEFT JOIN proofs q USING (doc_id)
"""
