"""Language ID, sharding, preferences and the pipeline against plain versions and held-out rows."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import langid, minhash, preference, quality, secrets, sharding
from ledgerloom.llm.queries import SQL, op2_label_propagation, op6_preference_pairs, op10_byte_gru

from ..conftest import SF

# ---- language ID


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    m = langid.BiGRU(["a", "b", "c"], 4)
    m.w = {k: v.astype("f8") for k, v in m.w.items()}
    rows, labels, weights = rng.integers(0, 5, (7, 6)), rng.integers(0, 3, 6), np.full((7, 6), 1 / 42)
    grads = m.gradients(rows, labels, weights)[1]
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, out = m.w[k][at], []
        for e in (1e-5, -1e-5):
            m.w[k][at] = kept + e
            out.append(m.gradients(rows, labels, weights)[0])
        m.w[k][at] = kept
        assert np.isclose((out[0] - out[1]) / 2e-5, g[at], rtol=1e-4, atol=1e-8)


def test_pooling_covers_every_byte():
    m = langid.BiGRU(["a", "b"])
    text = b"some bytes of a text " * 9
    whole = m.pooled([text, b"", text])
    assert np.allclose(whole[0].sum(), 1, atol=1e-5) and (whole[1] == 0).all() and np.allclose(whole[0], whole[2])
    parts = [text[i : i + langid.WINDOW] for i in range(0, len(text), langid.WINDOW)]
    by_part = m.pooled(parts)
    assert np.allclose(whole[0], (by_part * np.array([[len(p)] for p in parts])).sum(0) / len(text), atol=1e-5)


def test_query_op10(spark):
    got = {r["doc_id"]: r for r in op10_byte_gru(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for d, r in got.items())
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_odd_texts_are_und(spark):
    kind = "doc_id long, text string, lang string"
    rows = [(i, "the and of to in " * 6, "en") for i in range(40)] + [(100 + i, "der die das und nicht " * 6, "de") for i in range(40)]
    odd = [(900, None, "en"), (901, "", None), (902, "12 345 !?", "de"), (903, "x" * 100_000, None), (0, "the and of to in " * 6, "en")]
    df = spark.createDataFrame(rows + odd, kind).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(0))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages_of(df).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] in ("de", "en") and got[0][0] == "en" and got[101][0] == "de"
    assert {r["lang_pred"] for r in langid.languages_of(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.languages_of(df.limit(0)).collect() == []


# ---- sharding


def check_shards(rows, docs):
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in docs)
    texts = dict(docs)
    load = Counter(r["shard"] for r in rows)
    sizes = [load.get(s, 0) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_query_op2(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_shards(op2_label_propagation(spark, SF).collect(), docs)


def test_groups_come_together_and_large_ones_are_split(spark):
    docs = [(i, f"single {i}") for i in range(500)] + [(1000 + i, f"pair {i // 3}") for i in range(150)] + [(5000 + i, "hot") for i in range(300)] + [(9000, None), (9001, None), (9002, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("g", F.lit(1))
    rows = sharding.shard_documents(df).collect()
    check_shards(rows, docs)
    where = {}
    for r in rows:
        if 1000 <= r["doc_id"] < 2000:
            where.setdefault(docs[500 + r["doc_id"] - 1000][1], set()).add(r["shard"])
    assert sum(len(s) == 1 for s in where.values()) >= 0.8 * len(where)
    assert len({r["shard"] for r in rows if 5000 <= r["doc_id"] < 9000}) <= 24


def test_few_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    check_shards(sharding.shard_documents(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], kind)).collect(), [(1, "a"), (1, "a"), (2, None)])
    assert sharding.shard_documents(spark.createDataFrame([], kind)).collect() == []


# ---- preferences


def test_query_op6_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(SQL["op6_preference_pairs"]).df()
    got = op6_preference_pairs(spark, SF).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert len(got) and key(got) == key(want)


def test_prefix_is_rendered_once(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "bad"), (2, 3, "user", "more"), (2, 3, "user", "more")]
    turns += [(3, 0, "user", "x"), (4, 0, "user", "x"), (5, 0, None, None), (None, 0, "user", "n"), (6, None, "user", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("said", F.lit("clash")).withColumn("side", F.lit(1))
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 5, None), (4, 1, 3)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r for r in preference.format_preferences(df, pairs).collect()}
    one = got[1]
    assert (one["n_prompt_turns"], one["prompt"]) == (2, "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n")
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n" and one["chosen_spans"] == "14:18"
    s, e = map(int, one["rejected_spans"].split(":"))
    assert one["rejected"][s:e] == "bad" and one["rejected"].endswith("<|user|>\nmore<|end|>\n")
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert (got[3]["prompt"], got[3]["rejected"], got[3]["rejected_spans"]) == ("<|unknown|>\n<|end|>\n", None, None) or got[3]["prompt"] == ""
    assert got[4]["n_prompt_turns"] == 0
    assert preference.format_preferences(df.limit(0), preference.neighbour_pairs(df.limit(0))).collect() == []


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    talks = spark.read.parquet(f"{SF}/conversations.parquet")
    for df in (sharding.shard_documents(docs), preference.format_preferences(talks, preference.neighbour_pairs(talks))):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# ---- the pipeline


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline
    from corpus_pipeline import STAGES

    assert [n for n, _ in STAGES] == ["language ID", "quality rules", "MinHash near-dedup", "secret scans", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in STAGES[:-1]:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        after = {r["doc_id"]: r for r in kept.collect()}
        assert kept.columns == columns and set(after) <= set(before) and len(after) == kept.count()
        if name == "quality rules":
            for d, r in before.items():
                counts = quality.text_counts(r["text"])[0]
                if counts[0] < 50 or 100 * counts[4] > 50 * counts[0]:
                    assert d not in after
        if name == "MinHash near-dedup":
            sets = {d: set(minhash.shingle_set(r["text"], 5).tolist()) for d, r in before.items()}

            def linked(a, b):
                both = len(sets[a] & sets[b])
                return both and 100 * both >= 80 * len(sets[a] | sets[b])

            comp = {d: d for d in sets}
            for _ in range(4):
                for a in sorted(sets):
                    for b in sorted(sets):
                        if a < b and comp[a] != comp[b] and linked(a, b):
                            comp[a] = comp[b] = min(comp[a], comp[b])
            assert set(after) == {d for d in sets if comp[d] == d}
        if name == "secret scans":
            assert set(after) == set(before)
            for d, r in after.items():
                assert not secrets.unwrap(r["text"])[1] and r["n_chars"] == len(r["text"])
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in kept.collect()}


def test_stages_take_odd_rows(spark):
    from corpus_pipeline import STAGES

    words = " ".join(f"the and of {i}" for i in range(40))
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, words, "en", None, None), (3, words, "en", None, None), (4, words + " x", None, "s", 1), (5, "é " * 100, "fr", "s", 200)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, kind)
    for table in (df, df.limit(0), df.withColumn("score", F.lit("clash")).withColumn("rep", F.lit(1))):
        for name, stage in STAGES:
            out = stage(spark, table, SF)
            out.collect()
            if name != "packing":
                assert out.columns == table.columns


def test_near_dedup_keeps_rows_without_an_id(spark):
    from corpus_pipeline import STAGES

    stage = dict(STAGES)["MinHash near-dedup"]
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abc"]
    rows = [(None, texts[0], 1), (None, texts[0], 2), (None, texts[1], 3), (7, texts[1], 4), (8, texts[2], 5), (8, texts[2], 6), (8, texts[0] + " x", 7), (9, None, 8), (9, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("text_key", F.lit("clash"))
    got = stage(spark, df, SF)
    assert got.columns == df.columns
    # the rows with 8 are one document, so texts 0 and 2 are of one group, whose smallest doc_id is 8
    left = sorted((r["doc_id"] or 0, r["score"]) for r in got.collect())
    assert len(left) == 4 and [d for d, _ in left] == [7, 8, 9, 9] and left[0] == (7, 4)


def test_columns_named_as_results_stay(spark):
    from corpus_pipeline import STAGES

    text = " ".join(f"word{i} the" for i in range(60))
    df = spark.createDataFrame([(1, text, "en", "mine", 5)], "doc_id long, text string, lang string, score string, f_word int")
    for name, stage in STAGES[2:4]:
        assert [tuple(r) for r in stage(spark, df, SF).collect()] == [(1, text, "en", "mine", 5)], name
    found = langid.languages_of(df, "_l", "_s", "_h").first()
    assert found["score"] == "mine" and found["_l"] == "en"


@pytest.mark.parametrize("missing", ["rows"])
def test_unlabelled_corpus(spark, missing):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert langid.languages_of(df).first()["lang_pred"] == "und"
