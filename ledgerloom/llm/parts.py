"""Encoding many texts at once: each distinct part of a chunk of texts is encoded once.

A text may be cut before a space that has a sign other than white space on both sides: no
piece of the usual splitting pattern reaches over such a place, and none looks past it, so
the parts split into pieces on their own as they do inside the text. Cutting, counting parts
alike as one, and putting the ids of the parts together again work on Arrow buffers; only
the distinct parts, joined to one text, meet an encoder. Nothing is kept between chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are encoded together; one text may be longer, and then is a chunk of its own
CHUNK = 16 << 20


def text_chunks(batches: Iterable[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[pa.Table]:
    """The rows of all batches in order, cut and put together to chunks of about ``size`` bytes of text."""
    held: list[pa.Table] = []
    filled = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < len(ends):
            stop = max(at + 1, int(np.searchsorted(ends, done + size - filled, "right")))
            held.append(table.slice(at, stop - at))
            filled += int(ends[stop - 1]) - done
            at, done = stop, int(ends[stop - 1])
            if filled >= size:
                yield pa.concat_tables(held).combine_chunks()
                held, filled = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def large_strings(column) -> pa.LargeStringArray:
    """One array of the texts with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def _buffers(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins (and the end)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[places[0] : places[-1]]
    return data, places - places[0]


def _wide(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether three bytes, or the first two of them, are white space beyond ASCII."""
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & ((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    other = (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E)) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return two | general | other


def _solid(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the signs that begin at ``first`` and those that end at ``last`` are no white space; ASCII controls count as such."""
    out = (data[first] > 32) & (data[last] > 32)
    odd = np.flatnonzero(out & ((data[first] >= 0xC2) | (data[last] >= 0x80)))
    if len(odd):
        f, e, n = first[odd], last[odd], len(data) - 1
        begins = _wide(data[f], data[np.minimum(f + 1, n)], data[np.minimum(f + 2, n)])
        three, two, one = data[np.maximum(e - 2, 0)], data[np.maximum(e - 1, 0)], data[e]
        out[odd] = ~(begins | _wide(three, two, one) | (two == 0xC2) & _wide(two, one, one))
    return out


def parts_of(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The parts of all texts in a row, and the number of the first part of each text (and the end)."""
    data, places = _buffers(texts)
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(places), np.int64)
    begins = data == 32
    begins[0] = begins[-1] = False
    spaces = np.flatnonzero(begins)
    begins[spaces] = _solid(data, spaces + 1, spaces - 1)
    begins[places[:-1][places[:-1] < places[1:]]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts, len(data))
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))
    return parts, np.searchsorted(starts, places)


class Encoder:
    """Ids of texts by ``encode`` (a text's ids as an array), which must give the pieces of the usual pattern one by one.

    ``lengths`` has the number of bytes of each id's token.
    """

    def __init__(self, encode: Callable[[str], np.ndarray], lengths: np.ndarray):
        self.encode, self.lengths = encode, lengths

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (and the end)."""
        parts, first = parts_of(texts)
        if not len(parts):
            return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
        alike = parts.dictionary_encode()
        data, places = _buffers(alike.dictionary)
        # parts " sign ... sign" follow each other as they would in a text: these are encoded as one
        begin, size = places[:-1], np.diff(places)
        joins = (data[begin] == 32) & (size > 1)
        at = np.flatnonzero(joins)
        joins[at] = _solid(data, begin[at] + 1, places[1:][at] - 1)
        together, ends = _buffers(alike.dictionary.filter(pa.array(joins)))
        ids = [np.asarray(self.encode(together.tobytes().decode()), np.uint32)] if len(together) else []
        counts = np.zeros(len(size), np.int64)
        if ids:
            token_ends = np.cumsum(self.lengths[ids[0]])
            upto = np.searchsorted(token_ends, ends[1:])
            if not (token_ends[np.minimum(upto, len(token_ends) - 1)] == ends[1:]).all():
                raise ValueError("a token reaches over the end of a part")
            counts[: len(upto)] = np.diff(upto + 1, prepend=0)
        apart = alike.dictionary.filter(pa.array(~joins)).to_pylist()
        for k, part in enumerate(apart, len(ends) - 1):
            ids.append(np.asarray(self.encode(part), np.uint32))
            counts[k] = len(ids[-1])
        order = np.empty(len(size), np.int64)
        order[joins] = np.arange(len(ends) - 1)
        order[~joins] = np.arange(len(ends) - 1, len(size))
        codes = np.ascontiguousarray(np.concatenate(ids), "<u4")
        bounds = np.r_[0, np.cumsum(counts)] * 4
        codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(codes)])
        whole = codes.take(pa.array(order[alike.indices.to_numpy()]))
        _, places, data = whole.buffers()
        places = np.frombuffer(places, np.int64)[: len(whole) + 1]
        return np.frombuffer(data, "<u4")[: places[-1] // 4], places[first] // 4
