"""The Merkle manifest against a plain tree, and its query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle
from ledgerloom.llm.queries import SQL, op12_merkle_manifest

from ..conftest import SF

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def plain_tree(leaves, fanout):
    """The root, and for each leaf the digests beside its path."""
    proofs, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            run = i // fanout * fanout
            proofs[k] += [d for j, d in enumerate(leaves[run : run + fanout], run) if j != i]
        leaves = [merkle.digest("".join(leaves[i : i + fanout])) for i in range(0, len(leaves), fanout)]
        at = [i // fanout for i in at]
    return leaves[0], proofs


def plain_leaf(row):
    return merkle.digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows, fanout):
    """{leaf: (subroot, root, proof)}"""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), plain_leaf(r)))
    trees = []
    for g in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        leaves = [d for _, d in sorted(groups[g])]
        trees.append((leaves, *plain_tree(leaves, fanout)))
    root, above = plain_tree([t[1] for t in trees], fanout)
    return {d: (sub, root, "".join(p + up)) for (leaves, sub, proofs), up in zip(trees, above) for d, p in zip(leaves, proofs)}


ROWS = (
    [(i, "hot", "en", i, f"Text {i} é") for i in range(150)]
    + [(1000 + i, f"s{i % 7}", None, None, None if i % 3 else "") for i in range(20)]
    + [(2000, None, "de", 1, "A" * 60_000), (None, None, "de", 2, "x"), (2001, "lone", "en", 3, "ONE")]
    + [(3000, "tie", "en", 1, "b"), (3000, "tie", "en", 1, "a"), (3001, "é", "en", 1, "a"), (3002, "ｚ", "en", 1, "a"), (3003, "𐐀", "en", 1, "a")]
)


@pytest.mark.parametrize("fanout, levels", [(16, 3), (2, 2), (3, 1)])
def test_manifest_equals_a_plain_tree(spark, fanout, levels):
    df = spark.createDataFrame(ROWS, KIND).withColumns({"tree": F.lit("clash"), "digest": F.lit(1), "_key": F.lit("x")}).repartition(5)
    got = merkle.manifest(df, "source", "doc_id", merkle.leaf_of([F.col(c) for c in merkle.COLUMNS]), fanout=fanout, levels=levels)
    want = plain_manifest(ROWS, fanout)
    rows = merkle.folded_roots(got.withColumn("doc_id", F.col("doc_id").cast("string")), fanout=fanout).collect()
    assert {r["leaf"]: (r["subroot"], r["root"], bytes(r["proof"]).hex()) for r in rows} == want and len(rows) == len(ROWS)
    assert all(r["folded_root"] == r["root"] for r in rows)


def test_equal_rows_keep_places_of_their_own(spark):
    rows = [(1, "a", "en", 1, "same")] * 40
    got = merkle.manifest(spark.createDataFrame(rows, KIND), "source", "doc_id", merkle.leaf_of([F.col(c) for c in merkle.COLUMNS])).collect()
    leaf = plain_leaf(rows[0])
    assert sorted(r["place"] for r in got) == list(range(40)) and {r["subroot"] for r in got} == {plain_tree([leaf] * 40, 16)[0]}


def test_folding_sees_another_leaf_or_place():
    leaves = [merkle.digest(str(i)) for i in range(40)]
    root, proofs = plain_tree(leaves, 16)
    proof = bytes.fromhex("".join(proofs[17]))
    assert merkle.folded(leaves[17], proof, [(17, 40)]) == root
    assert merkle.folded(leaves[18], proof, [(17, 40)]) != root and merkle.folded(leaves[17], proof, [(18, 40)]) != root
    with pytest.raises(ValueError):
        merkle.folded(leaves[17], proof + b"x" * 32, [(17, 40)])


def test_tampering(spark):
    docs = spark.createDataFrame(ROWS, KIND)
    got = merkle.tamper_report(docs).collect()
    changed = {plain_leaf(r): plain_leaf((*r[:4], r[4] and r[4].translate({k: k + 32 for k in range(65, 91)}))) for r in ROWS}
    import zlib

    for r in got:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["verified"] == (not hit or changed[r["leaf"]] == r["leaf"]) == (r["folded_root"] == r["root"])
    assert not all(r["verified"] for r in got) and merkle.tamper_report(docs.limit(0)).collect() == []


def test_query_op12_equals_its_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duckdb.sql(SQL["op12_merkle_manifest"]).df()
    got = op12_merkle_manifest(spark, SF).select(*want.columns).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
