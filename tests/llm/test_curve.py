"""What the space-filling curve and the label propagation are for: neighbours are alike, few links are cut."""

from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from ledgerloom.llm import packing, sharding
from ledgerloom.llm.queries import op8_hilbert_packing

from ..conftest import SF


def test_neighbours_on_the_curve_are_alike(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) > 200").dropDuplicates(["text"]).collect()
    texts = {r["doc_id"]: r["text"] for r in docs}
    ids, bounds = packing.TextIds(path, packing.merges_by_rank(path))(pa.array(texts.values(), pa.large_string()))
    vectors = np.sqrt(packing.hashed_counts(ids, bounds))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    at = {d: k for k, d in enumerate(texts)}
    first = {}
    for r in op8_hilbert_packing(spark, SF).where("start = 0").collect():
        first[r["doc_id"]] = (r["sequence_id"], r["offset"])
    along = [at[d] for d in sorted(at, key=first.get)]
    chance = np.random.default_rng(0).permutation(along)

    def mean_cosine(order):
        return float((vectors[order[:-1]] * vectors[order[1:]]).sum(1).mean())

    assert mean_cosine(along) > mean_cosine(chance) + 0.1


@pytest.mark.parametrize("groups, size", [(480, 5), (800, 3), (300, 0)])
def test_few_links_are_cut(spark, groups, size):
    """The hardest case: every row is linked, so none gives way and room comes from swaps alone."""
    rng = np.random.default_rng(3)
    docs = [(i, f"text {i % groups if size else rng.integers(0, groups)}") for i in range(groups * (size or 5))]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    whole, parts = Counter(r["text_crc32"] for r in rows), Counter((r["text_crc32"], r["shard"]) for r in rows)

    def pairs(counts):
        return sum(n * (n - 1) // 2 for n in counts.values())

    assert pairs(whole) - pairs(parts) <= 0.05 * pairs(whole)
