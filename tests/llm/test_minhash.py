"""MinHash near-dedup against all pairs of full sets."""

import random
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import minhash
from ledgerloom.llm.queries import op5_lsh_forest

from ..conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = {d: shingles(t, k) for d, t in rows}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def documents(seed=3, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(words).upper()
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 8, 60, 150])))))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_all_pairs(spark, k):
    rows = documents()
    got = as_dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=k))
    assert got == brute(rows, k)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "REGION", 8)
    rows = documents(9, 40) + [(1000 + i, "the same words again and again " * 8 + f"tail{i}") for i in range(50)]
    assert as_dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)) == brute(rows, 4)


def test_pairs_whose_min_hashes_agree_little_are_compared(spark):
    # similarity 0.8, in the same region of a tree, but fewer than 39 of the first 64 values agree
    rows = []
    for n in (10439, 17871, 43817):
        words = [f"w{n}x{k}" for k in range(13)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:-1], "z"]))]
    got = as_dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows, 5) and [got[d][1] for d in range(6)] == [0, 0, 2, 2, 4, 4]


@pytest.mark.parametrize("n", [5, 40, 900, 200_000])
def test_the_sketch_rejects_no_similar_pair(n):
    rng = np.random.default_rng(n)
    for share in (0.8, 0.81, 0.95):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        more = int(n / share) - n
        sets = [np.r_[both, rng.integers(0, 1 << 63, k, dtype=np.uint64)] for k in (more // 2, more - more // 2)]
        part = pd.DataFrame({"rep": [1, 2], "sketch": [minhash._sketch(x) for x in sets]})
        assert minhash._may_be_similar(80)(part)(0, np.array([1])).all()


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "é ünd ß"), (8, "É ünd ß"), (9, "a b c d"), (10, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(0)).withColumn("cluster", F.lit("x"))
    assert as_dict(minhash.near_duplicates(df, words=4)) == brute(rows, 4)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_large_groups_with_rows_apart(spark, monkeypatch):
    """The middle row of a large cluster is near to few others; links among the rest are found by blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 6)
    monkeypatch.setattr(minhash, "REGION", 4)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):  # chains: each text is near to the one before it only
        if i % 15:
            words = [*words[2:], f"w{100 + 2 * i}", f"w{101 + 2 * i}"]
        rows.append((i if i % 2 else 500 - i, " ".join(words)))
    rnd.shuffle(rows)
    assert as_dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4)) == brute(rows, 4)


def test_regions_have_the_least_depth_that_fits(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REGION", 3)
    rnd = random.Random(8)
    runs = {i: [tuple(rnd.choice([[1], [1, 2], [1, 2, 3]][d % 3]) for d in range(minhash.DEPTH)) for _ in range(2)] for i in range(60)}
    raw = [(i, 0, [np.array(r, ">u4").tobytes() for r in rs]) for i, rs in runs.items()]
    df = spark.createDataFrame(raw, "rep long, text_key long, runs array<binary>").repartition(5)
    got = {}
    for r in minhash.forest_regions(df).collect():
        got.setdefault(r["region"], []).append(r)
    want = []
    for t in range(2):
        done = set()
        for d in range(minhash.SHALLOW, minhash.DEPTH + 1):
            by = {}
            for i in runs.keys() - done:
                by.setdefault(runs[i][t][:d], set()).add(i)
            for members in by.values():
                if len(members) <= 3 or d == minhash.DEPTH:
                    done |= members
                    if len(members) > 1:
                        want.append((d, sorted(members)))
    assert sorted((rs[0]["depth"], sorted(r["rep"] for r in rs)) for rs in got.values()) == sorted(want)
    assert all(r["bucket_size"] == len(rs) for rs in got.values() for r in rs)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "g h i j k l"), (7, "m n o p q r"), (9, "M n o p q r"), (None, "g h i j k l"), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), (r["component_id"] or 0), r["kept"]) for r in got) == [(0, 0, True)] * 3 + [(0, 7, False)] + [(7, 7, True)] * 2 + [(9, 7, False)]
    groups = [r["group_id"] for r in got if r["doc_id"] is None and r["component_id"] is None and r["n_shingles"]]
    assert len(groups) == 2 and len(set(groups)) == 1


def test_repeated_rows(spark):
    got = minhash.near_duplicates(spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (3, "A b c d e")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(3, 3), (5, 3), (5, 3)]


def test_very_long_text_has_all_its_shingles():
    text = " ".join(f"word{i}" for i in range(50_000))
    assert len(minhash.shingle_set(text, 5)) == 49_996


def test_word_hashes_depend_on_words_alone():
    a, b = minhash.word_hashes(b"xx  alpha beta"), minhash.word_hashes(b"alpha\nbeta alpha")
    assert a[1] == b[0] == b[2] and a[2] == b[1] and len(set(np.r_[a, b].tolist())) == 3


def test_query_covers_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert as_dict(op5_lsh_forest(spark, SF)) == brute(rows, 4)


def test_texts_are_read_twice_and_no_shuffle_stays(spark, monkeypatch):
    """A scan for signatures and one for all comparisons, also where groups are compared in blocks; finished jobs leave no shuffle files."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "REGION", 8)
    rows = documents(9, 40) + [(1000 + i, "the same words again and again " * 8 + f"tail{i}") for i in range(50)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    def shuffled():
        return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    before, batch = shuffled(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInPandas(counted, "doc_id long, text string")
    found = minhash.near_duplicates(docs, words=4)
    assert shuffled() <= before
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    assert as_dict(found) == brute(rows, 4)
    assert seen.value == 2 * len(rows)


def test_the_pipelines_stage_leaves_no_intermediate_files(spark):
    from corpus_pipeline import _near_dedup
    from ledgerloom.llm.common import shared_folder

    def kept():
        folder = Path(shared_folder(spark).removeprefix("file:"))
        return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size(), len(list(folder.glob("table-*")))

    before = kept()
    rows = _near_dedup(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    after = kept()
    assert after[0] <= before[0] and after[1] == before[1]
    assert 0 < rows.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
