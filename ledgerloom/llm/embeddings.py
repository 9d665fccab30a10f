"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the centred vectors is learned on a bounded sample (at most ``FIT_ROWS``
vectors, documented bound, near copies among them taken once) by alternating between binary codes and the orthogonal matrix
that maps the vectors closest to them; bits are cut at sample medians, so they are
balanced. Codes are split into substrings, one hash table each; the width of the substrings
follows the size of the largest label, and the number of tables is planned so that a pair at
the threshold itself agrees in a substring with a probability of ``RECALL`` (pairs above it
with more). Centring by the mean takes more from the cosine of vectors that lie on the mean's
side, so the plan takes the ``SIDE`` quantile of the sample's products with the mean.
Whatever meets in a table is ranked by the cosine of the original vectors in double precision.

Equal vectors of one label are compared once. A pair that meets in several tables counts
in the first one only; links are counted inside blocks, and no pairs are emitted.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and vectors without a label, link with nothing; very small and very large components are
scaled before lengths are taken; vectors of different lengths never link; repeated rows count
as vectors of their own; different vectors with one vec_id are one vec_id with the links of
all of them; rows with a null vec_id have links and are counted as links of others, and a
component of nothing but such rows has a null component_id, which counts as their own; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SALTS, in_blocks, map_blocks, smallest_reachable, with_bucket_size
from .common import checkpointed, connected_components, drawn

THRESHOLD = 0.93
FIT_ROWS = 8192
RECALL = 0.998
SIDE = 0.99
ROUNDS = 50
BUCKET = 32
BLOCK = 512
_SEED = 3


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; first by the largest component, so that no square is lost or too large."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def thinned(sample: np.ndarray, threshold: float = THRESHOLD, seed: int = _SEED) -> np.ndarray:
    """Unit vectors of a sample without near copies, so that no large group of copies shapes the code.

    Padded with random directions where hardly any vectors remain.
    """
    unit = unit_vectors(sample)
    kept = unit[:0]
    for i in range(0, len(unit), 256):
        part = unit[i : i + 256]
        if len(kept):
            part = part[(part @ kept.T < threshold).all(1)]
        fresh: list[int] = []
        near = part @ part.T >= threshold
        for j in range(len(part)):
            if not near[j, fresh].any():
                fresh.append(j)
        kept = np.vstack([kept, part[fresh]])
    lacking = 16 * unit.shape[1] - len(kept)
    if lacking > 0:
        extra = np.random.default_rng(seed).standard_normal((lacking, unit.shape[1]))
        kept = np.vstack([kept, extra / np.linalg.norm(extra, axis=1, keepdims=True)])
    return kept


class Quantiser:
    """Rotations learned for one length of vectors: the code bits are signs of rotated coordinates."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = _SEED):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        x = sample - self.mean
        self.planes = []
        for _ in range(-(-bits // x.shape[1])):
            turn = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
            for _ in range(rounds):
                codes = np.where(x @ turn >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(codes.T @ x)
                turn = (left @ right).T
            self.planes.append(turn)
        self.planes = np.hstack(self.planes)[:, :bits]
        self.cuts = np.median(x @ self.planes, axis=0)

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        return (unit_vectors(vectors) - self.mean) @ self.planes > self.cuts


def centred_cosine(sample: np.ndarray, threshold: float) -> float:
    """The cosine that is left after centring of a pair of unit vectors at the threshold, on the side of the mean."""
    mean = sample.mean(0)
    square, side = float(mean @ mean), float(np.quantile(sample @ mean, SIDE))
    lost = 2 * side - square
    return max((threshold - lost) / max(1 - lost, 1e-9), 0.1)


def table_plan(largest: int, centred: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring and the number of tables for labels of up to ``largest`` vectors, for pairs of a cosine after centring."""
    width = min(16, max(4, round(math.log2(max(largest, 1) / BUCKET))))
    same = 1 - math.acos(min(centred, 1.0)) / math.pi  # a bit's chance to agree at the threshold
    return width, math.ceil(math.log(1 - recall) / math.log(1 - same**width))


def _usable():
    v = F.col("embedding")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    some = F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return F.col("label").isNotNull() & fine & some


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    usable = rows.where(_usable()).withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    # equal vectors of a label are one class; counted and joined per salt, so that large classes are spread
    same = ["label", "embedding"]
    fine = usable.groupBy(*same, "_salt").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy(*same)
    # a class has a number of its own, so that one whose vec_ids are all null is a class like others
    number = F.when(F.row_number().over(over.orderBy("_salt")) == 1, F.monotonically_increasing_id())
    fine = fine.withColumns({"smallest": F.min("low").over(over), "copies": F.sum("n").over(over), "number": number})
    fine = checkpointed(fine.select(*same, "_salt", F.max("number").over(over).alias("rep"), "copies", "smallest", F.col("number").isNotNull().alias("first")))
    # classes that share their smallest vec_id are one node of the links; seldom there are any
    named = fine.where("first and smallest is not null").groupBy("smallest").agg(F.min("rep").alias("node"), F.count(F.lit(1)).alias("n"))
    shared = named.where("n > 1").select("smallest", "node")
    if not shared.isEmpty():
        fine = checkpointed(fine.join(shared, "smallest", "left").withColumn("rep", F.coalesce("node", "rep")).drop("node"))
    classes = fine.where("first").select("rep", "label", "embedding", "copies", F.size("embedding").alias("dims"))

    counts = classes.groupBy("label", "dims").count().groupBy("dims")
    sizes = counts.agg(F.max("count").alias("largest"), F.sum("count").alias("n")).collect()  # one row per length
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    draw = drawn(classes.select("rep", "dims", "embedding"), sum(r["n"] for r in sizes), fit_rows, "rep", seed=_SEED).collect()
    by_length: dict[int, list] = {}
    for r in sorted(draw):
        by_length.setdefault(r["dims"], []).append(r["embedding"])
    plans, models = {}, {}
    for r in sizes:
        sample = thinned(np.array(by_length.get(r["dims"]) or np.eye(r["dims"])), threshold)
        width, tables = plans[r["dims"]] = table_plan(r["largest"], centred_cosine(sample, threshold))
        models[r["dims"]] = Quantiser(sample, width * tables)

    def coded(batches):
        for pdf in batches:
            keys = np.empty(len(pdf), dtype=object)
            for d, at in pdf.groupby("dims").indices.items():
                width, tables = plans[d]
                bits = models[d].bits(np.stack(pdf["embedding"].to_numpy()[at]).astype(float))
                found = bits.reshape(len(at), tables, width) @ (1 << np.arange(width))
                for i, k in zip(at, found.astype(np.int64), strict=True):
                    keys[i] = k
            yield pdf.assign(keys=keys)

    classes = classes.withColumn("class", F.monotonically_increasing_id())
    kinds = ", ".join(f"{c} {t}" for c, t in classes.dtypes)
    classes = checkpointed(classes.mapInPandas(coded, f"{kinds}, keys array<long>"))
    light = classes.select("class", "label", "dims", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "dims", "table", "key"]
    blocks = in_blocks(with_bucket_size(light, bucket, "class"), "class", BLOCK)
    full = blocks.join(classes.select("class", "rep", "embedding", "copies", "keys"), "class").drop("class")

    def compare(part):
        ids = part["rep"].to_numpy()
        x = np.stack(part["embedding"].to_numpy()).astype(float)
        x = unit_vectors(x)
        keys, copies = np.stack(part["keys"].to_numpy()), part["copies"].to_numpy()
        table, own, lo, hi = int(part["table"].iloc[0]), part["own"].to_numpy(), part["lo"].iloc[0], part["hi"].iloc[0]
        near = x @ x.T >= threshold
        if lo != hi:  # rows of one part meet in that part's own block
            near &= own[:, None] != own[None, :]
        a, b = np.nonzero(np.triu(near, 1))
        if not len(a):
            return []
        root = smallest_reachable(ids, a, b)
        first = np.ones(len(a), bool)
        for s in range(0, len(a), 1 << 18):
            e = slice(s, s + (1 << 18))
            first[e] = ~(keys[a[e], :table] == keys[b[e], :table]).any(1)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a[first], copies[b[first]])
        np.add.at(links, b[first], copies[a[first]])
        linked = np.zeros(len(ids), bool)
        linked[a] = linked[b] = True
        return list(zip(ids[linked].tolist(), links[linked].tolist(), root[linked].tolist(), strict=True))

    found = checkpointed(map_blocks(full, bucket, compare, ["rep", "links", "root"], "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    # a component is named by the smallest vec_id in it
    named = components.join(fine.where("first").select("rep", "smallest").distinct(), "rep").groupBy("component").agg(F.min("smallest").alias("name"))
    per_class = links.join(components, "rep").join(named, "component").select("rep", "links", "name")
    # classes learn their links by rep, vectors by (vector, salt): a class of very many copies stays spread
    settled = fine.join(per_class, "rep", "left").select(
        *same,
        "_salt",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("name", "smallest").alias("component_id"),
    )
    known = usable.join(settled, [*same, "_salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(_usable(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
