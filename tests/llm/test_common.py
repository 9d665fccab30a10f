import random

import numpy as np

from ledgerloom.llm.blocks import in_blocks, map_blocks, smallest_reachable, with_bucket_size
from ledgerloom.llm.common import connected_components, with_rank


def test_components_equal_union_find(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(i, i + 1) for i in range(300, 340)]
    comp = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in comp.items() if x in got}
    assert {x for e in edges if e[0] != e[1] for x in e} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_and_running_sums(spark):
    df = spark.range(0, 1000).selectExpr("id", "id * 7 % 13 as k", "id % 5 as w")
    rows = sorted(with_rank(df, "k", "id", rank="at", weight="w").collect(), key=lambda r: (r["k"], r["id"]))
    total = 0
    for i, r in enumerate(rows):
        assert r["at"] == i and r["at_start"] == total
        total += r["w"]


def test_every_pair_of_a_bucket_meets_once(spark):
    rows = spark.createDataFrame([(i, 0 if i < 40 else i) for i in range(45)], "id long, k long")
    blocks = in_blocks(with_bucket_size(rows, ["k"], "id"), "id", 8)

    def pairs(part):
        ids, own = part["id"].tolist(), part["own"].tolist()
        apart = part["lo"].iloc[0] != part["hi"].iloc[0]
        return [(min(a, b), max(a, b)) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and not (apart and own[i] == own[j])]

    got = [tuple(r) for r in map_blocks(blocks, ["k"], pairs, ["a", "b"], "a long, b long").collect()]
    assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


def test_smallest_reachable():
    ids = np.array([9, 4, 7, 1, 5])
    assert smallest_reachable(ids, np.array([0, 2]), np.array([2, 1])).tolist() == [4, 4, 4, 1, 5]
