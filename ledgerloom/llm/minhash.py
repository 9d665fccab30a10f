"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Each tree of the forest is an order of the documents by a signature, a run of ``DEPTH``
MinHash values. The orders are range-sorted over the cluster; the longest common prefix of
each document with its sorted neighbours tells which documents lie in a region, at any depth.
The depth follows the region: a document takes the least depth from ``SHALLOW`` on at which
at most ``REGION`` documents share its prefix, at most the full length. All documents of a
region are candidates, also where it is large at the full length.

A pair of similarity 0.8 agrees in a full signature with a probability of 0.8**DEPTH, so all
trees miss it with one below 4e-5, however deep the regions are; that is the only loss.
Candidates are passed over only where a bound proves that they aren't similar: each document
counts its shingles in ``SKETCH`` bins, and the sum of the smaller counts of two documents is
at least the number of shingles they share. The others tie documents into candidate clusters.
Inside each cluster full shingle sets are compared, and confirmed links make the components.

Regions and clusters of more than ``BLOCK`` documents are compared in blocks, first all with
one middle document (linear), then those it isn't linked with against all
(:func:`blocks.edges_in_groups`). Documents with equal shingle sets are one class and are
compared once. Edges are stars, at most one per document and block, never all pairs.

Defined results: null texts and texts without words have no shingles and link with nothing;
shorter texts than a shingle are one shingle; exact and repeated rows link with each other;
rows that share a doc_id but not the text are one document with several texts, which links
with whatever one of them links with; a row with a null doc_id links as others do, but isn't
the smallest of its group, and component_id is null where no row of the group has a doc_id;
doc_ids are longs below 2**63 - 2**41; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SALTS, edges_in_groups, with_bucket_size
from .common import checkpointed, connected_components, little_kept, removed, written

WORDS = 5
SIMILARITY = 80  # percent
TREES = 26
SHALLOW = 3
DEPTH = 5
SKETCH = 512
REGION = 32
BLOCK = 512
_SEED = 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(_SEED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_MULTIPLY = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)[:, None] | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)[:, None]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_STEP, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased UTF-8 bytes, from running sums over the bytes."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _SPACE[b]
    starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[:n], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted, distinct hashes of the text's shingles."""
    if not isinstance(text, str) or not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text.encode().translate(_LOWER))
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += w[i : i + n] * _PLACE[i]
    return np.unique(_mixed(h))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each hash function's 32-bit values over a set."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        values = _MULTIPLY * short[i : i + 512]
        values += _ADD
        np.minimum(low, values.min(1), out=low)
    return low


def _sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each bin, up to 255."""
    bins = np.bincount((shingles % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.minimum(bins, 255).astype(np.uint8).tobytes()


#: ids of rows without a doc_id, above all others
_NAMELESS = (1 << 63) - (1 << 41)


def row_node(doc_id: str = "doc_id", text_key: str = "text_key"):
    """The id by which a row is compared: its doc_id, else a number from its text above all doc_ids."""
    return F.coalesce(F.col(doc_id), F.lit(_NAMELESS) + F.pmod(F.col(text_key), F.lit(1 << 40)))


def text_key(text: str = "text"):
    """A number by which the rows of one doc_id with different texts are told apart."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("t"), F.col(text)), F.lit("")))


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, node, text_key, n_shingles, set_key, runs (a signature by tree), sketch; one pass over the texts."""
    rows = docs.select("doc_id", text_key().alias("text_key"), "text").withColumn("node", row_node())

    def run(batches):
        for pdf in batches:
            found = []
            for text in pdf["text"]:
                s = shingle_set(text, words)
                if not len(s):
                    found.append((0, None, None, None))
                    continue
                raw = min_hashes(s).astype(">u4").tobytes()  # bytes in this order sort as the values do
                runs = [raw[i : i + 4 * DEPTH] for i in range(0, len(raw), 4 * DEPTH)]
                found.append((len(s), hashlib.md5(s.tobytes()).digest(), runs, _sketch(s)))
            out = pdf[["doc_id", "node", "text_key"]].reset_index(drop=True)
            more = ["n_shingles", "set_key", "runs", "sketch"]
            out[more] = pd.DataFrame(found, columns=more, index=out.index)
            yield out

    return rows.mapInPandas(run, "doc_id long, node long, text_key long, n_shingles long, set_key binary, runs array<binary>, sketch binary")


def _neighbours(batches) -> pd.DataFrame | None:
    """All rows of one sorted partition, and the values of their runs."""
    held = [pdf for pdf in batches if len(pdf)]
    if not held:
        return None
    rows = pd.concat(held, ignore_index=True)
    return rows, np.frombuffer(b"".join(rows["run"]), ">u4").reshape(len(rows), DEPTH)


def _prefix_lengths(rows: pd.DataFrame, runs: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row with the one before it, -1 where another tree begins."""
    out = np.full(len(rows), -1)
    same = rows["tree"].to_numpy()[1:] == rows["tree"].to_numpy()[:-1]
    alike = np.logical_and.accumulate(runs[1:] == runs[:-1], axis=1).sum(1)
    out[1:] = np.where(same, alike, -1)
    return out


def forest_regions(classes: DataFrame) -> DataFrame:
    """(rep, text_key, region, depth, bucket_size) of the documents that share a region with another one, by tree.

    ``classes`` has rep, text_key and runs. The runs of all trees are range-sorted. A region
    may lie over several partitions: of each partition, the prefixes of its first and last row
    with their numbers of rows (a handful of numbers) are added up on the driver.
    """
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = classes.select("rep", "text_key", F.posexplode("runs").alias("tree", "run"))
    order = ["tree", "run", "rep", "text_key"]
    depths = range(SHALLOW, DEPTH + 1)

    def neighbours(batches):
        """Leaves out rows that share no region with the row before or behind; the first and last ones of a partition stay."""
        if (found := _neighbours(batches)) is None:
            return
        near = np.append(_prefix_lengths(*found), SHALLOW) >= SHALLOW
        near[0] = True
        yield found[0][near[:-1] | near[1:]]

    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = checkpointed(ordered.mapInPandas(neighbours, ordered.schema))

    def borders(batches):
        if (found := _neighbours(batches)) is None:
            return
        rows, runs = found
        common, out = _prefix_lengths(rows, runs), []
        for d in depths:
            starts = np.flatnonzero(common < d)
            ends = np.append(starts[1:], len(rows))
            for k in {0, len(starts) - 1}:
                at = starts[k]
                out.append((int(rows["tree"].iloc[at]), d, rows["run"].iloc[at][: 4 * d], int(ends[k] - at)))
        yield pd.DataFrame(out, columns=["tree", "depth", "prefix", "n"])

    at_borders: dict[tuple[int, int, bytes], int] = {}
    for r in placed.mapInPandas(borders, "tree int, depth int, prefix binary, n long").collect():  # a few rows per partition
        key = r["tree"], r["depth"], bytes(r["prefix"])
        at_borders[key] = at_borders.get(key, 0) + r["n"]

    def regions(batches):
        if (found := _neighbours(batches)) is None:
            return
        rows, runs = found
        common, tree = _prefix_lengths(rows, runs), rows["tree"].to_numpy()
        depth, size = np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64)
        for d in depths:
            starts = np.flatnonzero(common < d)
            ends = np.append(starts[1:], len(rows))
            sizes = ends - starts
            for k in {0, len(starts) - 1}:
                sizes[k] = at_borders[int(tree[starts[k]]), d, rows["run"].iloc[starts[k]][: 4 * d]]
            now = np.repeat(sizes, ends - starts)
            fits = (depth == 0) & ((now <= REGION) | (d == DEPTH))
            depth[fits], size[fits] = d, now[fits]
        key = _mixed(tree.astype(np.uint64) * _STEP + depth.astype(np.uint64))
        for d in range(DEPTH):
            key = np.where(d < depth, _mixed(key * _STEP + runs[:, d].astype(np.uint64) + np.uint64(1)), key)
        out = rows[["rep", "text_key"]].assign(region=key.view(np.int64), depth=depth, bucket_size=size)
        yield out[size > 1]

    return checkpointed(placed.mapInPandas(regions, "rep long, text_key long, region long, depth int, bucket_size long"))


def _may_be_similar(percent: int):
    def near(part: pd.DataFrame):
        """Whether documents may be similar by the bound of their sketches."""
        s = np.frombuffer(b"".join(part["sketch"]), np.uint8).reshape(len(part), SKETCH)
        sizes = s.sum(1, dtype=np.int64)
        open_ended = s.max(1) == 255  # counts that stop at 255 prove nothing

        def test(i: int, others: np.ndarray) -> np.ndarray:
            most = np.minimum(s[others], s[i]).sum(1, dtype=np.int64)
            return (100 * most >= percent * (sizes[i] + sizes[others] - most)) | open_ended[others] | open_ended[i]

        return test

    return near


def _similar(words: int, percent: int):
    def near(part: pd.DataFrame):
        """Whether documents are similar by their full sets."""
        sets = [shingle_set(x, words) for x in part["text"]]
        sizes = np.array([len(x) for x in sets])
        starts = np.r_[0, np.cumsum(sizes)]
        # numbers instead of hashes; a document's own numbers are marked to count what others share with it
        numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
        marked = np.zeros(int(numbers.max()) + 1, np.int32)

        def test(i: int, others: np.ndarray) -> np.ndarray:
            mine = numbers[starts[i] : starts[i + 1]]
            marked[mine] = 1
            low, high = others[0], others[-1] + 1
            shared = np.add.reduceat(marked[numbers[starts[low] : starts[high]]], starts[low:high] - starts[low])[others - low]
            marked[mine] = 0
            return 100 * shared >= percent * (sizes[i] + sizes[others] - shared)

        return test

    return near


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, group_id of every row of (doc_id, text).

    Documents are linked with 100 * shared shingles >= percent * all shingles of both.
    group_id is alike for all rows of a group, also where they have no doc_id; null without shingles.
    Signatures and the texts of candidates are written once as Parquet and removed when compared.
    """
    with little_kept(docs.sparkSession):
        return _near_duplicates(docs, words, percent)


def _near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    signed, signed_folder = written(signatures(docs.select(F.col("doc_id").cast("long"), "text"), words))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    known = checkpointed(signed.drop("runs", "sketch").withColumn("_salt", salt))
    full = known.where("set_key is not null")
    # classes of equal sets; counted and joined per salt, so that large classes are spread
    fine = full.groupBy("set_key", "_salt").agg(F.min("node").alias("low"), F.min_by("text_key", "node").alias("text_key"))
    fine = checkpointed(fine.withColumn("rep", F.min("low").over(Window.partitionBy("set_key"))))
    heads = fine.where("rep = low").select("rep", "text_key", "set_key")
    member = signed.where("set_key is not null").select(F.col("node").alias("rep"), "text_key", "set_key", "runs", "sketch")
    row = ["rep", "text_key"]
    classes, classes_folder = written(member.join(heads, [*row, "set_key"], "left_semi").dropDuplicates(row).drop("set_key"))
    removed(spark, signed_folder)

    regions = forest_regions(classes.select(*row, "runs"))
    sketched, sketched_folder = written(regions.drop("depth").join(classes.select(*row, "sketch"), row))
    removed(spark, classes_folder)
    tied = edges_in_groups(sketched, ["region"], row, _may_be_similar(percent), BLOCK)
    removed(spark, sketched_folder)
    # candidate clusters, and inside them the links by full sets
    clusters = connected_components(tied).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    placed = checkpointed(with_bucket_size(clusters.join(heads.select(*row).distinct(), "rep"), ["cluster"], "rep"))
    texts = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").select(row_node().alias("rep"), "text_key", "text")
    candidates, candidates_folder = written(placed.join(texts, row).dropDuplicates(row))
    links = edges_in_groups(candidates, ["cluster"], row, _similar(words, percent), BLOCK)
    removed(spark, candidates_folder)
    components = connected_components(links).withColumnRenamed("node", "rep")

    # classes learn their component by rep, documents by (set, salt): a class of very many copies stays spread
    settled = fine.join(components, "rep", "left").select("set_key", "_salt", F.coalesce("component", "rep").alias("group_id"))
    linked = full.select("doc_id", "n_shingles", "text_key", "set_key", "_salt").join(settled, ["set_key", "_salt"]).drop("set_key", "_salt")
    linked = linked.withColumn("component_id", F.when(F.col("group_id") < _NAMELESS, F.col("group_id")))
    bare = known.where("set_key is null").select("doc_id", "n_shingles", "text_key", F.lit(None).cast("long").alias("group_id"), F.col("doc_id").alias("component_id"))
    both = linked.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return both.select("doc_id", "n_shingles", "component_id", "kept", "text_key", "group_id")
