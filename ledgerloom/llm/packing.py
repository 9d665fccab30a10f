"""Packing along a space-filling curve.

Each document's token ids are hashed to a small count vector, which a fixed random matrix
projects to a few dimensions; the Hilbert key of that point orders the documents, so that
neighbours on the curve have similar words. The documents are laid out along the curve
without gaps and cut at multiples of the sequence length, so every sequence but the last is
full.

Steps: one pass over the texts (ids, key, number of tokens), written to the shared
checkpoint folder; a distributed rank of the keys alone, with running token sums; a join of
each document's place with its ids; one pass that cuts the pieces. Ties on the curve are
ordered by doc_id and then by row, so a large group of copies is spread over partitions.

Defined results: a null text counts as empty and is one piece with the end id alone; a
special token written out in a text is that token's id, as the tokenizers library has it;
repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, with_rank
from .parts import Encoder, large_strings, text_chunks

SEQUENCE = 2048
END_ID = 1
DIMENSIONS = 4
BITS = 12
BUCKETS = 256
_SEED = 20_240_501


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of the points (rows of unsigned integers below 2**bits) on the Hilbert curve.

    The points are turned step by step from the highest bit down: a set bit of an axis flips
    the lower bits of the first axis, an unset one swaps them with the first axis' lower
    bits; a Gray code of the axes' bits then gives the place.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_points(vectors: np.ndarray, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Project hashed vectors to a grid; what lies beyond three deviations goes to the border."""
    matrix = np.random.default_rng(_SEED).standard_normal((vectors.shape[1], dimensions))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    at = vectors @ matrix / np.where(norm > 0, norm, 1)
    return np.clip((at + 3) / 6 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)


def _signs() -> dict[str, int]:
    """The sign by which vocabularies of byte-level BPE show each byte: printable ones as they are, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merges_by_rank(path: str) -> bool:
    """Whether merging the adjacent pair whose joined token has the smallest id gives this tokenizer file's ids for any text.

    The file is plain byte-level BPE, its merges stand in the order of the ids of what they
    make, and every token's own bytes merge to that token. That is enough. Take the first
    pair that is merged by id into a token t, but not by the file's merges. Until then both
    ways were alike, and no merge crossed the ends of t, so inside t the same merges were made
    as if t stood alone. Alone, its two last parts merge by a pair of the list; since the
    merges with smaller ids are all done, these parts are that pair, which is a contradiction.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, cut = data["model"], data["pre_tokenizer"] or {}
    if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or data["normalizer"] or model.get("continuing_subword_prefix"):
        return False
    if model.get("end_of_word_suffix") or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
        return False
    vocabulary, signs = model["vocab"], set(_signs())
    special = {t["content"] for t in data["added_tokens"]}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    if any(x < 0 or x >= y for x, y in zip(made, made[1:])) or not all(signs.issuperset(t) for t in vocabulary if t not in special):
        return False
    rank = {p: k for k, p in enumerate(pairs)}
    never = len(rank)
    for token in vocabulary.keys() - special:
        parts = list(token)
        while len(parts) > 1:
            costs = [rank.get(p, never) for p in zip(parts, parts[1:])]
            if (least := min(costs)) == never:
                return False
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


def id_width(path: str) -> int:
    """Bytes that every id of the tokenizer file fits in, 2 or 4."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocabulary = data["model"]["vocab"]
    most = max([*(vocabulary.values() if isinstance(vocabulary, dict) else [len(vocabulary)]), *(t["id"] for t in data["added_tokens"])])
    return 2 if most < 1 << 16 else 4


class TextIds:
    """The ids that the tokenizer file gives texts, by its own library; where ``by_rank`` is proved, by a faster one.

    What the file calls an added token stands for its id wherever it occurs in a text, as the
    library has it; a text that holds one is encoded by the library.
    """

    def __init__(self, path: str, by_rank: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.added = [t["content"] for t in data["added_tokens"]]
        self.fast = None
        if by_rank:
            import public_tokenizers
            import tiktoken

            signs = _signs()
            ranks = {bytes(signs[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in self.added}
            lengths = np.zeros(max(ranks.values()) + 1, np.int64)
            lengths[list(ranks.values())] = [len(b) for b in ranks]
            tool = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.fast = Encoder(tool.encode_to_numpy, lengths)

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the end)."""
        apart = np.zeros(len(texts), bool)
        if self.fast:
            for token in self.added:
                apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
            ids, bounds = self.fast(pc.if_else(pa.array(apart), "", texts) if apart.any() else texts)
            if not apart.any():
                return ids, bounds
            found = [ids[s:e] for s, e in zip(bounds, bounds[1:])]
        else:
            apart[:] = True
            found = [None] * len(texts)
        at = np.flatnonzero(apart)
        for i in range(0, len(at), 256):
            some = at[i : i + 256]
            for k, e in zip(some, self.tool.encode_batch_fast([texts[int(k)].as_py() for k in some], add_special_tokens=False), strict=True):
                found[k] = np.array(e.ids, np.uint32)
        return np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.uint32), np.r_[0, np.cumsum([len(x) for x in found], dtype=np.int64)]


_TOOLS: dict[tuple[str, bool], TextIds] = {}
#: tokens whose buckets are counted at once
_COUNTED = 1 << 20


def hashed_counts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of each text's ids fall into each of BUCKETS buckets."""
    bucket = (ids * np.uint32(2_654_435_761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    out = np.zeros((len(bounds) - 1, BUCKETS), np.float32)
    at = 0
    while at < len(out):
        end = max(at + 1, min(int(np.searchsorted(bounds, bounds[at] + _COUNTED, "right")) - 1, at + 4096))
        owner = np.repeat(np.arange(end - at) * BUCKETS, np.diff(bounds[at : end + 1]))
        counts = np.bincount(owner + bucket[bounds[at] : bounds[end]], minlength=(end - at) * BUCKETS)
        out[at:end] = counts.reshape(end - at, BUCKETS)
        at = end
    return out


def _encoded(path: str, by_rank: bool, width: int):
    def run(batches):
        key = (path, by_rank)
        tool = _TOOLS[key] if key in _TOOLS else _TOOLS.setdefault(key, TextIds(path, by_rank))
        pack = zstandard.ZstdCompressor(level=1)
        for rows in text_chunks(batches, "text"):
            ids, bounds = tool(large_strings(rows["text"]))
            places = hilbert_key(curve_points(np.sqrt(hashed_counts(ids, bounds))))
            code = ids.astype(f"<u{width}").data.cast("B")
            packed = [pack.compress(code[s * width : e * width]) for s, e in zip(bounds.tolist(), bounds[1:].tolist())]
            out = rows.select(["uid", "doc_id"]).append_column("hkey", pa.array(places, pa.int64()))
            out = out.append_column("n_tokens", pa.array(np.diff(bounds) + 1, pa.int64())).append_column("ids", pa.array(packed, pa.binary()))
            yield from out.to_batches()

    return run


def _cut(length: int, end_id: int, width: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for doc, at, n, code in zip(pdf["doc_id"], pdf["place_start"], pdf["n_tokens"], pdf["ids"], strict=True):
                ids = np.append(np.frombuffer(unpack.decompress(code), f"<u{width}"), end_id).astype("<u4")
                start = 0
                while start < n:
                    offset = (at + start) % length
                    size = min(length - offset, n - start)
                    rows.append((doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, (at + start) // length, offset))
                    start += size
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names the tokenizer file, which every executor must be able to open. The table
    needs the columns doc_id and text; others are not read.
    """
    rows = docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    width = id_width(path)
    coded = rows.mapInArrow(_encoded(path, merges_by_rank(path), width), f"uid long, doc_id {kind}, hkey long, n_tokens long, ids binary")
    coded = checkpointed(coded)
    placed = with_rank(coded.select("uid", "doc_id", "hkey", "n_tokens"), "hkey", "doc_id", "uid", rank="place", weight="n_tokens")
    both = coded.select("uid", "doc_id", "n_tokens", "ids").join(placed.select("uid", "place_start"), "uid")
    return both.mapInPandas(
        _cut(length, end_id, width), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
