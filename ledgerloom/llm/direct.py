"""Token ids in files of directly addressable codes: any token is read without decoding a block.

An id is split into chunks, lowest bits first, one chunk a level. A level holds the chunks of
all ids that reach it, packed to its width, a bitmap that says which of them go on to the
next level, and a rank directory over that bitmap: the place of an id in the next level is the
number of bits set before it, which is one directory number and at most ``BLOCK`` bits to
count. The widths of a file's levels are those with the least size for the lengths of its ids.

A file (little-endian) is: ``DAC1``, the numbers of levels, of ids and of documents, where the
file's first id stands in its partition, the levels' widths, for each level the numbers of
chunks and the places of its three parts; the documents' keys, which of them aren't null and
where each document ends; the levels; a checksum of all that.

Documents are range-sorted by key, and each task writes what it holds in chunks of about
``parts.CHUNK`` bytes of text as files of their own, named by partition and number, under
another name first: a task that runs again writes the same files. One number per partition
reaches the driver, the ids before it.

Defined results: a null text is an empty one and has the end id only; null keys come first;
rows of one key stand in the order of a hash of their texts; an empty table writes no file and
gives no rows. Keys are 64-bit integers. Other columns aren't read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_folder
from .packing import _signs
from .parts import _buffers, large_strings, parts_of, text_chunks

END_ID = 1
BLOCK = 512  # bits that one number of a rank directory stands for
MEMO_ENTRIES = 200_000
#: ids of a stretch of the whole order by which positions meet their files
STRETCH = 1 << 20
_HEAD = struct.Struct("<4sIQQQ")
_MAGIC = b"DAC1"
# fixed values: the word pattern and the normalisers under which no piece reaches over white space
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]


# ---- the codes


def best_widths(lengths: np.ndarray) -> list[int]:
    """Widths of the levels with the least bits in all; ``lengths[k]`` is how many ids have k bits."""
    most = max(int(np.flatnonzero(lengths).max(initial=1)), 1)
    longer = lengths.sum() - np.cumsum(lengths)  # ids with more than k bits
    longer = np.r_[lengths.sum(), longer[1:]]  # every id has a chunk in the first level
    cost, cut = [0.0] * (most + 1), [0] * (most + 1)
    for a in range(most - 1, -1, -1):
        options = []
        for b in range(a + 1, most + 1):
            bitmap = longer[a] * (1 + 32 / BLOCK) if b < most else 0
            options.append((longer[a] * (b - a) + bitmap + cost[b], b))
        cost[a], cut[a] = min(options)
    widths, a = [], 0
    while a < most:
        widths.append(cut[a] - a)
        a = cut[a]
    return widths


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one behind the other."""
    out = []
    for at in range(0, len(values), 1 << 18):  # a multiple of eight values fills whole bytes
        some = values[at : at + (1 << 18)]
        places = np.zeros((8, -(-len(some) // 8)), "<u4")  # row j has the values 8 * i + j: eight values are ``width`` bytes
        for j in range(8):
            places[j, : -(-(len(some) - j) // 8)] = some[j::8]
        places &= np.uint32((1 << width) - 1)
        packed = np.zeros((places.shape[1], width), "u1")
        for j in range(8):
            for byte in range(j * width // 8, (j * width + width + 7) // 8):
                shift = j * width - 8 * byte
                packed[:, byte] |= (places[j] << np.uint32(shift) if shift >= 0 else places[j] >> np.uint32(-shift)).astype("u1")
        out.append(packed.tobytes()[: (len(some) * width + 7) // 8])
    return b"".join(out)


def unpack_bits(raw: bytes, skip: int, count: int, width: int) -> np.ndarray:
    """``count`` values of ``width`` bits that begin ``skip`` bits into ``raw``."""
    out, data = np.zeros(count, "<u4"), bytes(raw) + bytes(8)
    for j in range(min(count, 8)):  # the values 8 * i + j lie ``width`` bytes apart
        first = skip + j * width
        words = np.ndarray(-(-(count - j) // 8), "<u8", data, first // 8, (width,))
        out[j::8] = words >> np.uint64(first % 8) & np.uint64((1 << width) - 1)
    return out


def encode_file(ids: np.ndarray, ends: np.ndarray, keys: pa.Array, start: int = 0) -> bytes:
    """The bytes of a file of documents; ``ends`` says where each one's ids end."""
    ids = np.ascontiguousarray(ids, "<u4")
    most = int(ids.max(initial=0)).bit_length()
    upto = [np.count_nonzero(ids < (1 << k)) for k in range(most)] + [len(ids)] * (34 - most)  # ids with k bits at most
    widths = best_widths(np.diff(upto, prepend=0))
    sections, levels, left = [], [], ids
    for k, width in enumerate(widths):
        more, directory, bitmap = left[:0], b"", b""
        if k + 1 < len(widths):
            goes = (left >> np.uint32(width)) > 0
            bitmap = np.packbits(goes, bitorder="little").tobytes()
            blocks = np.frombuffer(bitmap + bytes(-len(bitmap) % (BLOCK // 8)), "u1").reshape(-1, BLOCK // 8)
            counts = np.bitwise_count(blocks).sum(axis=1, dtype="i8")
            directory = np.r_[0, np.cumsum(counts)].astype("<u4").tobytes()
            more = left[goes] >> np.uint32(width)
        levels.append((width, len(left), pack_bits(left, width), bitmap, directory))
        left = more
    known = np.packbits(keys.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes()
    sections = [keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), known, np.asarray(ends, "<u8").tobytes()]
    place = _HEAD.size + 40 * len(widths) + sum(map(len, sections))
    table = b""
    for width, count, *three in levels:
        table += struct.pack("<QQQQQ", width, count, place, place + len(three[0]), place + len(three[0]) + len(three[1]))
        place += sum(map(len, three))
        sections += three
    body = _HEAD.pack(_MAGIC, len(widths), len(ids), len(keys), start) + table + b"".join(sections)
    return body + struct.pack("<I", zlib.crc32(body))


class TokenFile:
    """Reads a file of directly addressable codes; ``read(offset, size)`` gives bytes, of which only those needed are asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, levels, self.n_ids, self.n_docs, self.start = _HEAD.unpack(read(0, _HEAD.size))
        if magic != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        table = read(_HEAD.size, 40 * levels)
        self.levels = [struct.unpack_from("<QQQQQ", table, 40 * k) for k in range(levels)]
        self.docs_at = _HEAD.size + 40 * levels

    @classmethod
    def of(cls, raw: bytes) -> TokenFile:
        """A whole file in memory; its checksum is verified."""
        if len(raw) < 4 or zlib.crc32(memoryview(raw)[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("the file's checksum doesn't fit")
        view = memoryview(raw)
        return cls(lambda at, size: view[at : at + size])

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        """Keys, and where each document's ids end."""
        n = self.n_docs
        keys = np.frombuffer(self.read(self.docs_at, 8 * n), "<i8")
        known = np.unpackbits(np.frombuffer(self.read(self.docs_at + 8 * n, (n + 7) // 8), "u1"), bitorder="little")[:n]
        ends = np.frombuffer(self.read(self.docs_at + 8 * n + (n + 7) // 8, 8 * n), "<u8").astype("i8")
        return pa.array(keys, mask=known == 0), ends

    def _rank(self, level: int, at: int) -> int:
        """How many of the level's first ``at`` chunks go on."""
        _, _, _, bitmap, directory = self.levels[level]
        block = at // BLOCK
        before = struct.unpack("<I", self.read(directory + 4 * block, 4))[0]
        inside = at - block * BLOCK
        if not inside:
            return before
        raw = int.from_bytes(self.read(bitmap + block * BLOCK // 8, (inside + 7) // 8), "little")
        return before + (raw & ((1 << inside) - 1)).bit_count()

    def token(self, at: int) -> int:
        """One id: a few bytes of each level that it reaches."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        out = shift = 0
        for k, (width, _, chunks, bitmap, _) in enumerate(self.levels):
            first = at * width
            raw = int.from_bytes(self.read(chunks + first // 8, (first + width + 7) // 8 - first // 8), "little")
            out |= (raw >> first % 8 & (1 << width) - 1) << shift
            shift += width
            if k + 1 == len(self.levels) or not self.read(bitmap + at // 8, 1)[0] >> at % 8 & 1:
                return out
            at = self._rank(k, at)
        return out

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``, level by level."""
        out, places, shift = np.zeros(end - start, "<u4"), None, 0
        for k, (width, _, chunks, bitmap, _) in enumerate(self.levels):
            if end <= start:
                break
            first, last = start * width, end * width
            found = unpack_bits(self.read(chunks + first // 8, (last + 7) // 8 - first // 8), first % 8, end - start, width) << np.uint32(shift)
            if places is None:
                out = found
            else:
                out[places] |= found
            shift += width
            if k + 1 < len(self.levels):
                goes = np.unpackbits(np.frombuffer(self.read(bitmap + start // 8, (end + 7) // 8 - start // 8), "u1"), bitorder="little")
                goes = np.flatnonzero(goes[start % 8 :][: end - start])
                places = goes if places is None else places[goes]
                start, end = self._rank(k, start), self._rank(k, end)
        return out


# ---- ids of texts


def words_stand_alone(path: str) -> bool:
    """Whether the tokenizer file drops white space and lets no piece, normaliser or added token reach over it."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    first = ((data.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    split = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and first["pattern"] == {"Regex": _WORDS}
    kinds = [n["type"] for n in (data.get("normalizer") or {}).get("normalizers", [])]
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"]) for t in data["added_tokens"])
    return bool(split and added and kinds == _NORMALISERS and not data.get("post_processor"))


def ranks_with_ends(path: str) -> dict[bytes, int] | None:
    """Ids of the file's tokens as bytes, a word's end as one byte more, if merging by id gives the file's ids.

    That is so if the last sign of a word and its end make a token with a smaller id than any
    merge, the merges stand in the order of the ids of what they make, and every token's own
    signs merge to that token (see :func:`packing.merges_by_rank` for why that is enough).
    Otherwise there are none.
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    special = {t["content"] for t in data["added_tokens"]}
    suffix = model.get("end_of_word_suffix")
    if not words_stand_alone(path) or model["type"] != "BPE" or not suffix or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        return None
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    base = [i for t, i in vocabulary.items() if len(t.removesuffix(suffix)) == 1]
    if not made or any(x < 0 or x >= y for x, y in zip(made, made[1:])) or max(base) >= made[0]:
        return None
    rank, out, signs = {p: k for k, p in enumerate(pairs)}, {}, _signs()
    never = len(rank)
    for token, i in vocabulary.items():
        plain = token.removesuffix(suffix)
        if not plain or suffix in plain:
            return None
        parts = [*plain[:-1], plain[-1] + token[len(plain) :]]
        if any(x not in vocabulary for x in parts):
            return None
        while len(parts) > 1:
            costs = [rank.get(p, never) for p in zip(parts, parts[1:])]
            if (least := min(costs)) == never:
                return None
            at = costs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if not signs.keys() >= set(plain):
            return None
        raw = bytes(signs[c] for c in plain)
        if _END not in raw:
            out[raw + (_END if plain != token else b"")] = i
    return out


_END = b"\x01"
#: Signs up to U+017F that are printable ASCII, white space of ASCII or letters of Latin blocks: they
#: have no marks to compose, and each is lower-cased on its own to as many bytes. The one that isn't is left out.
_LAST, _DOTTED = 0xC5, "\u0130"
# what a byte is to the word pattern; other bytes aren't met
_SPACE, _LETTER, _DIGIT, _SYMBOL, _ODD = range(5)
_KINDS = np.full(256, _ODD, "u1")
_KINDS[0x21:0x7F] = _SYMBOL
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, _LAST + 1)]] = _LETTER
_KINDS[0x30:0x3A] = _DIGIT
_IS_ODD = _KINDS == _ODD


def pieces_of(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The pieces of the word pattern in lower-case texts of bytes that aren't odd, and the number of each text's first (and the end)."""
    data, places = _buffers(texts)
    n = len(data)
    kinds = _KINDS[data]
    at = np.flatnonzero(data == 0xC3)
    at = at[(data[at + 1] == 0x97) | (data[at + 1] == 0xB7)]  # times and division signs
    kinds[at] = kinds[at + 1] = _SYMBOL
    begins = np.ones(n + 3, bool)
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:n])
    begins[:n] |= kinds == _DIGIT
    begins[places] = True
    # an apostrophe alone before s, t, m, d, re, ve or ll takes these along
    at = np.flatnonzero(data == 0x27)
    end = places[np.searchsorted(places, at, "right")] if len(at) else at
    at = at[begins[at] & begins[at + 1] & (at + 1 < end)]
    end = places[np.searchsorted(places, at, "right")] if len(at) else at
    one, two = data[at + 1], data[np.minimum(at + 2, n - 1)]
    short = np.isin(one, [*b"stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    long &= at + 2 < end
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = begins[at[long] + 3] = True
    solid = kinds != _SPACE
    begins = begins[:n]
    first = np.searchsorted(np.flatnonzero(begins & solid), places)
    data, starts = data[solid], np.flatnonzero(begins[solid])
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data))
    return pieces, first


def _spread(ids: np.ndarray, counts: np.ndarray, indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct units, one behind the other, for the units in their order, and how many each has."""
    begin, many = np.cumsum(counts) - counts, counts[indices]
    at = np.repeat(begin[indices] - (np.cumsum(many) - many), many)
    at += np.arange(len(at))
    return ids[at], many


class WordIds:
    """The ids of the tokenizers library, for many texts at once.

    Where words stand alone, texts of Latin letters, printable ASCII and its white space are cut to
    pieces by their bytes, and the distinct pieces of a chunk are encoded together by a faster
    library, if merging by rank is proved to give the same. Other texts are cut at single spaces,
    and so are their parts if these have such signs only; the others' distinct parts are encoded by
    the tokenizers library, with a bounded memo.
    Where words don't stand alone, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.apart = words_stand_alone(path)
        self.memo: dict[str, bytes] = {}
        self.added = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks := ranks_with_ends(path):
            import tiktoken

            self.final = np.zeros(max(ranks.values()) + 2, bool)  # ids that end a piece
            self.final[[i for token, i in ranks.items() if token.endswith(_END)]] = True
            ranks[_END] = len(self.final) - 1  # never left over: every sign before an end merges with it first
            self.fast = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and how many each has."""
        alike = units.dictionary_encode()
        parts = alike.dictionary.to_pylist()
        out: list[bytes | None] = list(map(self.memo.get, parts))
        new = [i for i, c in enumerate(out) if c is None]
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            for i, e in zip(some, self.tool.encode_batch_fast([parts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
                if len(parts[i]) <= 24 and self.apart:
                    if len(self.memo) >= MEMO_ENTRIES:
                        self.memo.clear()
                    self.memo[parts[i]] = out[i]
        return _spread(np.frombuffer(b"".join(out), "<u4"), np.array([len(c) // 4 for c in out], "i8"), alike.indices.to_numpy())

    def _by_rank(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that are plain."""
        pieces, first = pieces_of(pc.utf8_lower(units))
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(len(units), "i8")
        alike = pieces.dictionary_encode()
        lines, _ = _buffers(pc.binary_join_element_wise(alike.dictionary, *[pa.scalar(v, pa.large_string()) for v in ("", _END.decode())]))
        ids = self.fast.encode_to_numpy(lines.tobytes().decode())
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(alike.dictionary) or ends[-1] != len(ids):
            raise ValueError("a token reaches over the end of a piece")
        ids, many = _spread(ids, np.diff(ends, prepend=0), alike.indices.to_numpy())
        return ids, np.diff(np.r_[0, np.cumsum(many)][first])

    def _plain(self, units: pa.LargeStringArray) -> np.ndarray:
        """Which units can be merged by rank."""
        if not self.fast:
            return np.zeros(len(units), bool)
        data, places = _buffers(units)
        plain = np.ones(len(units), bool)
        plain[np.searchsorted(places, np.flatnonzero(_IS_ODD[data]), "right") - 1] = False
        raw = data.tobytes()
        for token in [*self.added, _DOTTED]:
            if token.encode() in raw:
                plain &= ~pc.match_substring(units, token).to_numpy(zero_copy_only=False)
        return plain

    def _apart(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, which are cut to parts, and how many each has."""
        parts, first = parts_of(texts)
        ids, counts = self._by_kind(parts, self._by_library)
        return ids, np.diff(np.r_[0, np.cumsum(counts)][first])

    def _by_kind(self, units: pa.LargeStringArray, other: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, by ``other`` of those that aren't plain, and how many each has."""
        plain = self._plain(units)
        if plain.all():
            return self._by_rank(units)
        (some, has), (rest, have) = self._by_rank(units.filter(pa.array(plain))), other(units.filter(pa.array(~plain)))
        counts = np.empty(len(units), "i8")
        counts[plain], counts[~plain] = has, have
        own = np.repeat(plain, counts)
        ids = np.empty(len(own), "<u4")
        ids[own], ids[~own] = some, rest
        return ids, counts

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the end)."""
        ids, counts = self._by_kind(texts, self._apart if self.apart else self._by_library)
        return ids, np.r_[0, np.cumsum(counts)]


_TOOLS: dict[str, WordIds] = {}


# ---- files


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/"):
        folder = "file:///" + folder[5:].lstrip("/")
    elif "://" not in folder:
        folder = os.path.abspath(folder)
    return fs.FileSystem.from_uri(folder)


def _put(store: fs.FileSystem, place: str, raw: bytes) -> None:
    """Write under another name first, so that no reader and no second attempt meets half a file."""
    draft = f"{place}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        out.write(raw)
    try:
        store.move(draft, place)
    except OSError:
        if store.get_file_info(place).type == fs.FileType.NotFound:
            raise
        store.delete_file(draft)  # another attempt has written the same bytes


def with_ends(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with ``end_id`` behind each text's, and where each text's now end."""
    ends = bounds[1:] + np.arange(1, len(bounds))
    out = np.full(len(ids) + len(ends), end_id, "<u4")
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, ends


def write_tokens(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents in the order of ``key``; a row per file: part, file, start (in its part), n_ids, n_docs, size.

    ``path`` names the tokenizer file and ``folder`` a shared folder, which every executor must be able to open.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(n, "key", "tie", "row").sortWithinPartitions("key", "tie", "row")

    def run(batches):
        tool = _TOOLS[path] if path in _TOOLS else _TOOLS.setdefault(path, WordIds(path))
        part, start, out = TaskContext.get().partitionId(), 0, []
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        for k, table in enumerate(text_chunks(batches, "text")):
            ids, ends = with_ends(*tool(large_strings(table["text"])), end_id)
            name = f"part-{part:06d}-{k:06d}.dac"
            raw = encode_file(ids, ends, table["key"].combine_chunks(), start)
            _put(store, f"{place}/{name}", raw)
            out.append((part, name, start, len(ids), len(ends), len(raw)))
            start += len(ids)
        names = ["part", "file", "start", "n_ids", "n_docs", "size"]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({"file": object}), pa.schema([(c, pa.string() if c == "file" else pa.int64()) for c in names]), preserve_index=False)

    return checkpointed(rows.select("key", "text").mapInArrow(run, "part long, file string, start long, n_ids long, n_docs long, size long"))


def part_starts(files: DataFrame) -> DataFrame:
    """Rows (part, before): the ids of all parts before each; one row per partition."""
    at, rows = 0, []
    for part, n in sorted(map(tuple, files.groupBy("part").agg(F.sum("n_ids")).collect())):
        rows.append((part, at))
        at += n
    return files.sparkSession.createDataFrame(rows, "part long, before long")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_ids and ids (binary: little-endian unsigned 32-bit) read back from the files."""
    spark = files.sparkSession
    kinds = "part long, doc_id long, start long, n_ids long, ids binary"
    if not files.head(1):
        return spark.createDataFrame([], kinds).drop("part")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                file = TokenFile.of(content.as_buffer().to_pybytes())
                keys, ends = file.documents()
                ids, starts = file.tokens(0, file.n_ids), np.r_[0, ends[:-1]].astype("i8")
                part = int(name.as_py().rsplit("/", 1)[-1].split("-")[1])
                codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends] * 4), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), part)), keys, pa.array(starts + file.start), pa.array(ends - starts), codes.cast(pa.binary())],
                    ["part", "doc_id", "start", "n_ids", "ids"],
                )

    rows = raw.mapInArrow(run, kinds).join(F.broadcast(part_starts(files)), "part")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_ids", "ids")


def tokens_at(files: DataFrame, folder: str, positions: DataFrame) -> DataFrame:
    """The ``id`` at each ``position`` of the whole order; only the bytes that a position needs are read.

    Positions meet their file by equal stretches of the order; of one file they are read in
    blocks, so that many positions in one file are spread. Positions outside the order give no row.
    """
    index = files.join(F.broadcast(part_starts(files)), "part").select("file", (F.col("start") + F.col("before")).alias("first"), "n_ids")
    index = index.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor((F.col("first") + F.col("n_ids") - 1) / STRETCH))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("stretch", F.floor(F.col("position") / STRETCH))
    met = asked.join(index, "stretch").where((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_ids")))
    met = met.select("file", "position", (F.col("position") - F.col("first")).alias("at")).withColumn("block", F.pmod(F.xxhash64("position"), F.lit(16)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        store, place = _store(folder)
        with store.open_input_file(f"{place}/{pdf['file'].iloc[0]}") as source:

            def read(at: int, size: int) -> bytes:
                source.seek(at)
                return source.read(size)

            file = TokenFile(read)
            return pd.DataFrame({"position": pdf["position"], "id": [file.token(int(a)) for a in pdf["at"]]})

    return met.groupBy("file", "block").applyInPandas(run, "position long, id long")


def tokens_report(docs: DataFrame, path: str) -> DataFrame:
    """Query op11: starts, lengths and checksums of the ids as the files have them."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(docs, folder, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = read_tokens(files, folder)
    return rows.select(F.col("doc_id").cast(kind).alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
