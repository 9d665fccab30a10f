"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a piece of text the encoder keeps, for every byte prefix, the last token of the
prefix's encoding. A token may end a prefix only if it and the last token of what stands
before it encode to just these two; exactly one token does, so the table is unique, and the
encoding is read off backwards. Since the table of a prefix never depends on what follows,
appending bytes only adds entries, and an edit keeps every entry before it
(:class:`PrefixTable`).

The job itself is one pass over the rows: the distinct parts of a chunk of texts are split
into pieces (:mod:`parts`), and each worker keeps a bounded memo of the pieces it has met.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .parts import Encoder, large_strings, text_chunks

MEMO_ENTRIES = 400_000
_NEVER = 1 << 60


class Vocabulary:
    """Ranks of a byte-level BPE with what the prefix tables need."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        trie = ahocorasick.Automaton()
        for b, i in ranks.items():
            trie.add_word(b.decode("latin-1"), (len(b), i))
        trie.make_automaton()
        self.trie = trie

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging by rank; only used to decide about pairs of tokens, which are short."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < _NEVER:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
        return [ranks[p] for p in parts]

    def stands_alone(self, token: int) -> bool:
        """Whether the token's bytes encode to the token."""
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens encode to just these two."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= 4 * MEMO_ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def extend(self, piece: bytes, last: array, start: int) -> None:
        """Fill ``last`` (the last token of each prefix) for the prefixes longer than ``start``."""
        del last[start:]
        last.extend([-1] * (len(piece) - start))
        # tokens that end behind `start` may begin before it; the longest token bounds how far
        back = max(0, start - self.longest)
        known, own, checked = self._pairs.get, self._own.get, self.follows
        for end, (n, token) in self.trie.iter(piece[back:].decode("latin-1")):
            end += back
            if last[end] >= 0 or end < start:
                continue
            begin = end - n
            if begin >= 0:
                left = last[begin]
                if left >= 0:
                    fits = known(left << 32 | token)
                    if checked(left, token) if fits is None else fits:
                        last[end] = token
            elif own(token) or self.stands_alone(token):
                last[end] = token

    def read(self, piece: bytes, last: array) -> list[int]:
        """The encoding, read backwards from the table. A piece that is a token is that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        out, at = [], len(piece)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.bytes_of[token])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        last = array("l")
        self.extend(piece, last, 0)
        return self.read(piece, last)

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.encode_piece(m.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The prefix tables of a text, kept so that appends and edits re-encode only what changes."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.v, self.text = vocabulary, ""
        self.pieces: list[tuple[int, str, array]] = []  # where it starts, the piece, its table
        self.steps = 0  # prefixes filled so far, to see what was saved
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by ``new``."""
        text = self.text[:start] + new + self.text[end:]
        # The pattern looks one sign past a piece, so pieces ending before the edit stand, but for the last two.
        keep = len(self.pieces)
        while keep and self.pieces[keep - 1][0] + len(self.pieces[keep - 1][1]) >= start:
            keep -= 1
        keep = max(0, keep - 1)
        at = self.pieces[keep][0] if keep < len(self.pieces) else (len(self.text) if self.pieces else 0)
        old = self.pieces[keep:]
        shift = len(text) - len(self.text)
        later = {s + shift: (k, p) for k, (s, p, _) in enumerate(old) if s >= end}
        pieces = self.pieces[:keep]
        tables = {s: (p, t) for s, p, t in old}
        for m in self.v.pattern.finditer(text, at):
            if m.start() in later and m.start() >= start + len(new) and later[m.start()][1] == m[0] and self._settled(old, later[m.start()][0], shift, text):
                pieces += [(s + shift, p, t) for s, p, t in old[later[m.start()][0] :]]
                break
            raw = m[0].encode()
            table, same = array("l"), 0
            if m.start() in tables:
                was, had = tables[m.start()]
                was = was.encode()
                while same < min(len(was), len(raw)) and was[same] == raw[same]:
                    same += 1
                table = array("l", had[:same])
            self.v.extend(raw, table, same)
            self.steps += len(raw) - same
            pieces.append((m.start(), m[0], table))
        self.text, self.pieces = text, pieces

    @staticmethod
    def _settled(old, k, shift, text) -> bool:
        """From here the text is as before: matching depends on nothing before a piece's start."""
        s, _, _ = old[k]
        return text[s + shift :] == "".join(p for _, p, _ in old[k:])

    def ids(self) -> list[int]:
        return [t for _, p, table in self.pieces for t in self.v.read(p.encode(), table)]


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary per Python worker."""
    if (path, pattern) not in _VOCABULARIES:
        _VOCABULARIES[path, pattern] = Vocabulary.load(path, pattern)
    return _VOCABULARIES[path, pattern]


class Memo(dict):
    """Encodings (little-endian 32-bit ids) of the pieces that were met.

    Kept in two bounded generations: when the newer is full it becomes the older, and what is
    met again moves back to the newer, so that frequent pieces stay.
    """

    def __init__(self, v: Vocabulary, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.v, self.entries, self.older = v, entries, {}

    def __missing__(self, piece: str) -> bytes:
        code = self.older.get(piece)
        if code is None:
            code = array("I", self.v.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[piece] = code
        return code

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.v.pattern.findall(text))), "<u4")


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder with its memo per Python worker."""
    if (path, pattern) not in _ENCODERS:
        v = vocabulary(path, pattern)
        lengths = np.zeros(max(v.bytes_of) + 1, np.int64)
        for i, b in v.bytes_of.items():
            lengths[i] = len(b)
        _ENCODERS[path, pattern] = Encoder(Memo(v).ids, lengths)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids`` (binary: little-endian unsigned 32-bit ids) to the rows.

    A null text counts as empty; an empty text has no ids. ``path`` names the rank file,
    which every executor must be able to open.
    """
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != ids)

    def run(batches):
        encode = encoder(path, pattern)
        for rows in text_chunks(batches, text):
            found, bounds = encode(large_strings(rows[text]))
            raw = found.astype("<u4").data.cast("B")
            codes = [bytes(raw[4 * s : 4 * e]) for s, e in zip(bounds.tolist(), bounds[1:].tolist())]
            yield from rows.append_column(ids, pa.array(codes, pa.binary())).to_batches()

    return docs.drop(ids).mapInArrow(run, f"{kinds}, {ids} binary")


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest columns of query op9: ids by the prefix tables, then the bytes they decode to."""

    def run(batches):
        encode, v = encoder(path, pattern), vocabulary(path, pattern)
        signs = pa.array([v.bytes_of.get(i, b"") for i in range(max(v.bytes_of) + 1)], pa.large_binary())
        for rows in text_chunks(batches, "text"):
            ids, bounds = encode(large_strings(rows["text"]))
            raw, decoded, begins = ids.astype("<u4").data.cast("B"), b"", np.zeros(len(ids) + 1, np.int64)
            if len(ids):
                _, places, decoded = signs.take(pa.array(ids)).buffers()
                begins = np.frombuffer(places, np.int64)[: len(ids) + 1]
            decoded = memoryview(decoded)
            hashed = [hashlib.sha256(raw[4 * s : 4 * e]).hexdigest() for s, e in zip(bounds.tolist(), bounds[1:].tolist())]
            ends = begins[bounds].tolist()
            back = [hashlib.sha256(decoded[s:e]).hexdigest() for s, e in zip(ends, ends[1:])]
            out = rows.select(["doc_id"]).append_column("n_tokens", pa.array(np.diff(bounds), pa.int64()))
            yield from out.append_column("ids_sha256", pa.array(hashed, pa.string())).append_column("decoded_sha256", pa.array(back, pa.string())).to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
