"""Embedding near-dedup against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import embeddings
from ledgerloom.llm.queries import op1_itq_hamming

from ..conftest import SF

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    use = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links = {i: set() for i, _, _ in rows}
    for k, (i, v, lab) in enumerate(use):
        for j, w, other in use[k + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i].add(j)
                links[j].add(i)
    comp = {i: i for i in links}
    while True:
        new = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
        if new == comp:
            return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
        comp = new


def as_dict(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def vectors(n=150, d=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, d))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.standard_normal(d) * rng.choice([0.02, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return rows


def test_links_equal_all_pairs(spark):
    rows = vectors()
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)]  # exact copies
    got, want = as_dict(embeddings.near_duplicates(spark.createDataFrame(rows, KIND))), brute(rows)
    assert set(got) == set(want)
    assert sum(v[0] for v in want.values()) > 100
    found = sum(min(got[i][0], want[i][0]) for i in want) / sum(v[0] for v in want.values())
    assert found >= 0.99 and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.98 * len(want)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(4)
    v = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in v + rng.standard_normal(16) * 0.01], 0) for i in range(60)]
    assert as_dict(embeddings.near_duplicates(spark.createDataFrame(rows, KIND))) == brute(rows)


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, one, None), (8, one, 0), (9, [2.0, 4.0], 0), (10, [1.0, 2.0, 3.0], 0), (11, one, 1)]
    df = spark.createDataFrame(rows, KIND).withColumn("rep", F.lit("clash")).withColumn("copies", F.lit(1))
    got = as_dict(embeddings.near_duplicates(df))
    assert got == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11)} | {8: (1, 8, True), 9: (1, 8, False)}


def test_very_small_and_very_large_components(spark):
    rng = np.random.default_rng(6)
    rows = vectors(40)
    for k, scale in enumerate((1e-200, 1e200, 5e-324 * 2**40, 1e-300)):
        v = rng.standard_normal(16)
        rows += [(100 + 10 * k + i, [float(x) for x in (v + rng.standard_normal(16) * 0.01) * scale], 0) for i in range(3)]
    scaled = [(i, [x / max(map(abs, v)) for x in v], lab) for i, v, lab in rows]
    assert as_dict(embeddings.near_duplicates(spark.createDataFrame(rows, KIND.replace("float", "double")))) == brute(scaled)


def test_one_vec_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, KIND)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1)]


def test_null_vec_ids_have_links(spark):
    v = vectors(60)
    rows = [(None if i % 4 == 0 else i, x, lab) for i, x, lab in v] + [(None, [9.0] * 16, 7), (None, [18.0] * 16, 7)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    want = brute([*v, (1000, [9.0] * 16, 7), (1001, [18.0] * 16, 7)])
    null = {i for i, (k, _, _) in enumerate(rows) if k is None} | {1000, 1001}
    assert sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] is not None) == sorted((i, n) for i, (n, _, _) in want.items() if i not in null)
    assert sorted(r["n_links"] for r in got if r["vec_id"] is None) == sorted(n for i, (n, _, _) in want.items() if i in null)
    members = {}
    for i, (_, c, _) in want.items():
        members.setdefault(c, []).append(i)
    name = {c: min((i for i in own if i not in null), default=None) for c, own in members.items()}
    assert all(r["component_id"] == name[want[r["vec_id"]][1]] and r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert sum(r["component_id"] is None for r in got) == sum(len(members[c]) for c, k in name.items() if k is None) >= 2


def test_the_plan_counts_what_centring_takes():
    rng = np.random.default_rng(3)
    unit = embeddings.unit_vectors(rng.standard_normal((3000, 32)) + np.r_[2.0, np.zeros(31)])
    left = embeddings.centred_cosine(unit, 0.93)
    pairs = unit[:1000] * 0.93 + np.sqrt(1 - 0.93**2) * embeddings.unit_vectors(
        (x := rng.standard_normal((1000, 32))) - (x * unit[:1000]).sum(1, keepdims=True) * unit[:1000]
    )
    a, b = unit[:1000] - unit.mean(0), pairs - unit.mean(0)
    assert 0.1 < left < np.quantile((a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1), 0.1) < 0.93


def test_empty_table_and_repeated_rows(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], KIND)).collect() == []
    got = embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 0)] * 3, KIND)).collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == [(2, 1)] * 3


def test_more_width_needs_more_tables():
    plans = [embeddings.table_plan(n) for n in (10, 1_000, 100_000, 10_000_000)]
    assert embeddings.table_plan(1_000, centred=0.7)[1] > plans[1][1]
    assert plans == sorted(plans)


def test_query_covers_the_table(spark):
    got = as_dict(op1_itq_hamming(spark, SF))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got == brute(rows)
