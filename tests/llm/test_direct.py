"""Files of directly addressable codes: round trips, single ids, and the query against the library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import direct
from ledgerloom.llm.common import shared_folder
from ledgerloom.llm.queries import op11_direct_codes

from ..conftest import SF

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def a_file(ids, ends=None, keys=None):
    ids = np.asarray(ids, "u4")
    ends = np.array([len(ids)]) if ends is None else np.asarray(ends)
    return direct.TokenFile.of(direct.encode_file(ids, ends, pa.array(keys or [7] * len(ends), pa.int64()), 5))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_any_ids_come_back(ids, data):
    file = a_file(ids)
    assert file.tokens(0, file.n_ids).tolist() == ids and file.start == 5
    if ids:
        a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
        assert file.tokens(a, b).tolist() == ids[a:b] and [file.token(i) for i in range(a, min(b, a + 20))] == ids[a : min(b, a + 20)]


def test_single_ids_read_few_bytes():
    ids = np.random.default_rng(0).zipf(1.3, 300_000).clip(1, 49_000).astype("u4")
    raw = direct.encode_file(ids, np.array([len(ids)]), pa.array([1], pa.int64()))
    asked = []

    def read(at, size):
        asked.append(size)
        return raw[at : at + size]

    file = direct.TokenFile(read)
    assert len(file.levels) > 1 and len(raw) < 2 * len(ids)
    for at in (0, 511, 512, 513, 150_001, len(ids) - 1):
        asked.clear()
        assert file.token(at) == ids[at] and sum(asked) <= len(file.levels) * (4 + 64 + 8 + 1)
    with pytest.raises(IndexError):
        file.token(len(ids))
    with pytest.raises(ValueError):
        direct.TokenFile.of(raw[:100] + bytes([raw[100] ^ 1]) + raw[101:])


def test_widths_are_the_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        ids = (1 << rng.integers(0, 12, 500)) - rng.integers(0, 2, 500)
        lengths = np.bincount(np.frexp(ids.astype("f8"))[1], minlength=34)
        most = int(np.flatnonzero(lengths).max())

        def size(widths):
            bits, shift = 0.0, 0
            for k, w in enumerate(widths):
                n = len(ids) if not k else int((ids >> shift > 0).sum())
                bits, shift = bits + n * w + (n * (1 + 32 / direct.BLOCK) if k + 1 < len(widths) else 0), shift + w
            return bits

        every = [[b - a for a, b in zip((0, *cuts), (*cuts, most))] for cuts in ([c for c in range(1, most) if m >> (c - 1) & 1] for m in range(1 << (most - 1)))]
        assert np.isclose(size(direct.best_widths(lengths)), min(map(size, every)))


TEXTS = [
    None, "", " ", "Don't  stop\n\nthe   café's É é ΣΑΣ İ ǅ 12345 … a b　c", "<|endoftext|> x <|startoftext|>y<|endoftext|>", "a" * 3000,
    " ́ mark", "Straße ÇA Œuvre Ÿ ſ ŉ ĳ İx naïve×÷ ÄÖÜ's 'RE ½ «a» ÀÀÀÀ' é9é", "x" + " " * 500 + "y", "\u0085\x1c\x1f odd \x00 white", "日本語 한국어 हिन्दी 🙂👍🏽", "the end " * 4000, "'s 't it's", " don't ' s",
]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_the_librarys(path):
    tool = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS]
    ids, bounds = direct.WordIds(path)(pa.array(texts, pa.large_string()))
    assert direct.words_stand_alone(path) == (path == WORDS)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" '́ͅ\n sStdéẛΣ<|endoftext>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_ids_of_any_texts(texts):
    tool = _fuzzed()
    ids, bounds = tool(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in tool.tool.encode_batch(texts, add_special_tokens=False)]


def _fuzzed(held=[]):
    if not held:
        held.append(direct.WordIds(WORDS))
    return held[0]


def plain(rows):
    """{doc_id: (start, ids)} of (doc_id, text) rows."""
    tool, at, out = Tokenizer.from_file(WORDS), 0, {}
    for d, text in sorted(rows):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, direct.END_ID]
        out[d] = (at, ids)
        at += len(ids)
    return out, at


def test_query_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([tuple(r) for r in docs])
    got = op11_direct_codes(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        start, ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_odd_rows_and_single_positions(spark):
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumns({"ids": F.lit(1), "part": F.lit("x"), "key": F.lit(None)})
    folder = f"{shared_folder(spark)}/tokens-test"
    files = direct.write_tokens(df, folder, WORDS)
    want, total = plain(rows)
    got = {r["doc_id"]: (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in direct.read_tokens(files, folder).collect()}
    assert got == want
    whole = [i for _, (_, ids) in sorted(want.items()) for i in ids]
    at = [0, 1, 5, 777, total - 1, total // 2, total // 2, total, -1]
    found = direct.tokens_at(files, folder, spark.createDataFrame([(a,) for a in at], "position long")).collect()
    assert sorted(map(tuple, found)) == sorted((a, whole[a]) for a in at if 0 <= a < total)


def test_null_and_repeated_keys(spark):
    rows = [(None, "b b"), (None, "a"), (4, "one two"), (4, "one two"), (4, "three"), (9, None)]
    got = direct.tokens_report(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 4, 4, 4, 9] and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    assert direct.tokens_report(spark.createDataFrame([], "doc_id long, text string"), WORDS).collect() == []


class Counted:
    """Stands for a tool and keeps what it is asked."""

    def __init__(self, tool):
        self.tool, self.asked = tool, []

    def encode_to_numpy(self, text):
        self.asked += text.split("\x01")[:-1]
        return self.tool.encode_to_numpy(text)

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tool.encode_batch_fast(texts, **options)


def test_each_distinct_piece_is_encoded_once():
    tool = direct.WordIds(WORDS)
    texts = ["Word, word. (word)\nWORD! Word's  don't\r\n\tword\x0bÉté été,", "it's word 11 21", "中 word's"] * 50
    want = [e.ids for e in tool.tool.encode_batch(texts, add_special_tokens=False)]
    fast, slow = tool.fast, tool.tool = Counted(tool.fast), Counted(tool.tool)
    for part in (texts[:2] * 50, texts):
        fast.asked, slow.asked = [], []
        ids, bounds = tool(pa.array(part, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == (want[:2] * 50 if part is not texts else want)
        assert slow.asked == ([] if part is not texts else ["中"])
        # texts with other signs are encoded apart, so a piece comes twice at most
        assert max(map(fast.asked.count, fast.asked)) <= (1 if part is not texts else 2)
    assert {"word", "été", "'s", "'t", "1", ".", ")"} <= set(fast.asked)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  ''\n\t.,1stmdrevlSTMDREVL×÷éÉ"), st.characters(max_codepoint=0x17F)), max_size=30), max_size=8))
def test_ids_of_latin_texts(texts):
    tool = _fuzzed()
    ids, bounds = tool(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in tool.tool.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 31, 32])
def test_bits_lie_one_behind_the_other(width):
    values = np.random.default_rng(width).integers(0, 2**32, 1003).astype("u4")
    raw = direct.pack_bits(values, width)
    whole = sum((int(v) & (1 << width) - 1) << width * i for i, v in enumerate(values))
    assert raw == whole.to_bytes((len(values) * width + 7) // 8, "little")
    for at in (0, 1, 5, 8, 1002):
        assert direct.unpack_bits(raw[at * width // 8 :], at * width % 8, len(values) - at, width).tolist() == [int(v) & (1 << width) - 1 for v in values[at:]]
