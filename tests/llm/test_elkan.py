"""Vector codes by bounded Lloyd rounds against plain rounds, and the query against its SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import elkan
from ledgerloom.llm.queries import SQL, op13_elkan_codes

from ..conftest import SF

KIND = "vec_id long, embedding array<float>, label int"


def plain(q, parts, entries, rounds):
    """Codes, errors and codebooks with every distance computed; ``q`` in the order of ids."""
    x = q.reshape(len(q), parts, -1).astype(object)
    books = [x[:entries, p].copy() for p in range(parts)]

    def assign():
        codes, errors = np.zeros((len(q), parts), int), np.zeros(len(q), object)
        for p, b in enumerate(books):
            d = ((x[:, p][:, None] - b[None]) ** 2).sum(2)
            codes[:, p] = [min(range(len(b)), key=lambda e, r=r: (r[e], e)) for r in d]
            errors += d[np.arange(len(q)), codes[:, p]]
        return codes, errors

    for _ in range(rounds):
        codes, _ = assign()
        for p, b in enumerate(books):
            for e in range(len(b)):
                own = x[codes[:, p] == e, p]
                if len(own):
                    b[e] = [sum(c) // len(own) for c in own.T]
    return *assign(), books


def vectors(n, d, seed=0, copies=True):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((8, d))[rng.integers(0, 8, n)] + 0.3 * rng.standard_normal((n, d))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("f4")
    if copies:
        v[n // 2 : n // 2 + n // 3] = v[0]  # one group of copies
        v[5] = np.round(v[5] * 2) / 2  # ties
    return v


@pytest.mark.parametrize("d, parts, entries, rounds", [(64, 16, 64, 2), (8, 4, 5, 4), (6, 1, 3, 1)])
def test_codes_equal_plain_rounds(spark, d, parts, entries, rounds):
    v = vectors(400, d)
    rows = [(3 * i - 50, v[i].tolist(), i % 3 or None) for i in range(len(v))]
    df = spark.createDataFrame(rows[::-1], KIND).withColumn("code", F.lit("clash")).repartition(3)
    coded, books = elkan.vector_codes(df, parts, entries, rounds)
    got = elkan.with_errors(coded, books).orderBy("vec_id").collect()
    codes, errors, want = plain(np.floor(v.astype("f8") * 256).astype("i8"), parts, entries, rounds)
    assert [list(r["code"]) for r in got] == codes.tolist() and [r["error"] for r in got] == errors.tolist()
    assert all((a == b).all() for a, b in zip(books, want))
    if entries == 64:  # bounds leave far less to compute than all distances of all passes
        assert sum(r["n_distances"] for r in got) < 0.7 * len(v) * parts * entries * (rounds + 1)


def test_bounds_are_strict():
    """Rows at equal distances from two entries go to the lower one after any movement."""
    rng = np.random.default_rng(1)
    before, after = rng.integers(-9, 9, (12, 2)), rng.integers(-9, 9, (12, 2))
    x = rng.integers(-12, 12, (3000, 2)).astype("i8")
    one = elkan.Codebook(before)
    code, upper, lower, _ = one.first(x)
    upper, reach, share = elkan.packed_bounds(one, code, upper, lower)
    true = np.sqrt(((x[:, None] - before) ** 2).sum(2))
    kept = share.astype("f8") / 255 * reach[:, None] * (1 - 1e-12)
    assert (kept <= true).all() and (upper >= true[np.arange(len(x)), code]).all()
    got, up, low, _ = elkan.Codebook(after, before).again(x, code, upper.astype("f8"), kept)
    true = ((x[:, None] - after) ** 2).sum(2)
    assert (got == true.argmin(1)).all() and (low <= np.sqrt(true)).all() and (up >= np.sqrt(true.min(1))).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[float(i + j) / 7 - 1 for j in range(16)] for i in range(5)]
    bad = [None, [], [nan] * 16, [inf] + [0.0] * 15, [None] + [0.0] * 15, [1.0] * 15, [1.0] * 32, [1e30] * 16]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(100 + i, v, 1) for i, v in enumerate(bad)]
    rows += [(None, good[0], None), (2, good[2], 2), (7, [0.0] * 16, None)]
    got = elkan.codes_report(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == [(False, 0), (False, 1), (False, 2), (False, 2), (False, 3), (False, 4), (False, 7), (True, 0)]
    assert {r["error"] for r in got} == {0} and len({r["codebooks_sha256"] for r in got}) == 1
    assert elkan.codes_report(spark.createDataFrame(rows[:0], KIND)).collect() == []
    assert elkan.codes_report(spark.createDataFrame([(1, None, 1)], KIND)).collect() == []


def test_label_errors(spark):
    v = vectors(300, 16, 3)
    rows = [(i, v[i].tolist(), None if i % 2 else i % 4) for i in range(len(v))]
    got = elkan.codes_report(spark.createDataFrame(rows, KIND)).collect()
    total = {}
    for r in got:
        total[rows[r["vec_id"]][2]] = total.get(rows[r["vec_id"]][2], 0) + r["error"]
    assert all(r["label_error"] == total[rows[r["vec_id"]][2]] for r in got) and any(total.values())


def test_query_op13_equals_its_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duckdb.sql(SQL["op13_elkan_codes"]).df()
    got = op13_elkan_codes(spark, SF).select(*want.columns).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
