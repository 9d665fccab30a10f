"""Short codes of vectors by parts, with codebooks from Lloyd rounds that skip distances by Elkan's bounds.

Components become integers, so all distances are compared exactly: squared distances are
integers, and ties go to the lower index. Each part of each vector keeps an upper bound for
the distance to its entry and one lower bound for the distance to every entry. After an entry
has moved, bounds are shifted by how far it moved. A distance is computed only if the triangle
inequality leaves it open: an entry whose lower bound lies strictly above the part's upper
bound, or which is more than twice that far from the part's own entry, can't be nearest, nor as
near; what is left is decided by the integers. Bounds are rounded outwards, never inwards.

The state of a round (integers, codes, bounds) is one written table, which the next round
reads and replaces; a task that is lost is computed again from it. Lower bounds take a byte
each, as a share of a reach kept with each part, rounded down. Sums of entries are added up in
the tasks first; a codebook, and so what reaches the driver, has ``ENTRIES`` times the
vector's length of numbers however many vectors there are.

Defined results: vectors that are null or empty or hold null or non-finite components get no
row, nor do those whose length isn't a multiple of ``PARTS`` or isn't that of the usable vector
with the smallest vec_id, and those with components so large that squared distances might
leave 64 bits (beyond 520,000 in size at 64 components). Null vec_ids come last in the order that the first entries are taken in, rows of one
vec_id in the order of their vectors; each row counts. With fewer than ``ENTRIES`` vectors there
are as many entries. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_small, removed, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: larger components in size aren't taken, so that all integers fit 32 bits
LARGEST = 1 << 20
#: lower bounds reach so many upper bounds and half-gaps far; beyond, the reach itself is the bound
REACH = 4.0
_OUT, _IN = 1 + 1e-12, 1 - 1e-12


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return F.coalesce(fine, F.lit(False)) & (F.size(v) > 0)


def above(squares: np.ndarray) -> np.ndarray:
    """Distances of integer squares, not too small."""
    return np.sqrt(squares.astype("f8")) * _OUT


def below(squares: np.ndarray) -> np.ndarray:
    """Distances of integer squares, not too large."""
    return np.sqrt(squares.astype("f8")) * _IN


class Codebook:
    """The entries of one part (rows of integers) and how far they are from each other."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries.astype("i8")
        self.moved = above(((self.entries - before) ** 2).sum(1)) if before is not None else None
        gaps = below(((self.entries[:, None] - self.entries[None]) ** 2).sum(2)) / 2
        np.fill_diagonal(gaps, np.inf)
        self.half, self.nearest = gaps, gaps.min(1) if len(gaps) else gaps

    def squares(self, x: np.ndarray) -> np.ndarray:
        """All exact squared distances; by a product in doubles where that is exact."""
        big = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max(initial=0)), 1)
        if 4 * big * big * x.shape[1] < 1 << 53:
            a, b = x.astype("f8"), self.entries.astype("f8")
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype("i8")
        return ((x[:, None] - self.entries[None]) ** 2).sum(2)

    def first(self, x: np.ndarray):
        """Entry, upper bound, lower bounds and number of exact distances without earlier bounds."""
        squares = self.squares(x)
        code = squares.argmin(1)
        return code, above(squares[np.arange(len(x)), code]), below(squares), np.full(len(x), len(self.entries))

    def again(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """The same with the bounds of the round before, which are shifted by how far the entries moved."""
        upper = (upper + self.moved[code]) * _OUT
        lower = np.maximum((lower - self.moved) * _IN, 0)
        code, count = code.copy(), np.zeros(len(x), "i8")
        open_ = np.flatnonzero(~(upper < self.nearest[code]))
        if not len(open_):
            return code, upper, lower, count
        y, own, each = x[open_], code[open_], np.arange(len(open_))
        square = ((y - self.entries[own]) ** 2).sum(1)
        bound = above(square)
        near = lower[open_]
        near[each, own] = below(square)
        asked = ~(near > bound[:, None]) & ~(self.half[own] > bound[:, None])
        asked[each, own] = False
        row, entry = np.nonzero(asked)
        found = ((y[row] - self.entries[entry]) ** 2).sum(1)
        near[row, entry] = below(found)
        best = np.full(near.shape, np.iinfo("i8").max)
        best[each, own], best[row, entry] = square, found
        code[open_] = best.argmin(1)
        upper[open_] = above(best.min(1))
        lower[open_] = near
        count[open_] = 1 + asked.sum(1)
        return code, upper, lower, count


def packed_bounds(books: Codebook, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """Upper bounds and reaches as 32-bit floats and lower bounds as bytes, rounded outwards."""
    upper = np.nextafter(upper.astype("f4"), np.float32(np.inf))
    gap = books.nearest[code]
    reach = (REACH * (upper + np.where(np.isfinite(gap), gap, 0)) + 1).astype("f4")
    share = np.floor(np.minimum(lower / reach[:, None].astype("f8") * _IN, 1) * 255)
    return upper, reach, share.astype("u1")


def _column(batch, name: str, kind: str, *shape: int) -> np.ndarray:
    """A binary or list column with values of one size as an array."""
    col = batch.column(name)
    if pa.types.is_list(col.type):
        return col.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(len(col), *shape)
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), *shape)


def _binaries(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    size = flat.shape[1] * flat.itemsize
    return pa.array([bytes(r) for r in flat.view("u1").reshape(len(flat), size)], pa.binary())


_STATE = "code binary, upper binary, reach binary, lower binary, n_distances long"


def assigned(state: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None) -> DataFrame:
    """The state with each part's entry and its bounds; ``before`` are the codebooks that the bounds in ``state`` belong to."""
    parts, m, width = len(books), len(books[0]), books[0].shape[1]
    kinds = dict(state.dtypes)

    def run(batches):
        tables = [Codebook(b, None if before is None else before[p]) for p, b in enumerate(books)]
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = _column(batch, "q", "i8", parts, width)
            code, upper, reach = np.zeros((n, parts), "u1"), np.zeros((n, parts), "f4"), np.zeros((n, parts), "f4")
            lower, counts = np.zeros((n, parts, m), "u1"), np.zeros(n, "i8")
            if before is not None:
                code[:], upper[:], reach[:] = (_column(batch, c, k, parts) for c, k in (("code", "u1"), ("upper", "<f4"), ("reach", "<f4")))
                lower[:] = _column(batch, "lower", "u1", parts, m)
                counts += batch.column("n_distances").to_numpy()
            for p, table in enumerate(tables):
                if before is None:
                    made = table.first(x[:, p])
                else:
                    bounds = lower[:, p].astype("f8") / 255 * reach[:, p, None] * _IN
                    made = table.again(x[:, p], code[:, p].astype("i8"), upper[:, p].astype("f8"), bounds)
                code[:, p] = made[0]
                upper[:, p], reach[:, p], lower[:, p] = packed_bounds(table, *made[:3])
                counts += made[3]
            kept = [batch.column(c) for c in ("vec_id", "label", "q")]
            yield pa.RecordBatch.from_arrays(
                [*kept, _binaries(code), _binaries(upper), _binaries(reach), _binaries(lower), pa.array(counts, pa.int64())],
                ["vec_id", "label", "q", "code", "upper", "reach", "lower", "n_distances"],
            )

    names = ["vec_id", "label", "q"] if before is None else state.columns
    return state.select(*names).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<int>, {_STATE}")


def moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose entries are the floors of their parts' means; unused entries stay."""
    parts, m, width = len(books), len(books[0]), books[0].shape[1]

    def sums(batches):
        count, total = np.zeros((parts, m), "i8"), np.zeros((parts, m, width), "i8")
        for batch in batches:
            if len(batch):
                x, code = _column(batch, "q", "i8", parts, width), _column(batch, "code", "u1", parts)
                for p in range(parts):
                    count[p] += np.bincount(code[:, p], minlength=m)
                    for j in range(width):  # a batch's sums are exact in doubles
                        total[p, :, j] += np.bincount(code[:, p], x[:, p, j], m).astype("i8")
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype("i4")), pa.array(e.astype("i4")), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
        )

    rows = state.select("q", "code").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    wide = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"t{j}") for j in range(width)]
    out = [b.copy() for b in books]
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # one row per entry
        out[r["part"]][r["entry"]] = [int(r[f"t{j}"]) // r["n"] for j in range(width)]
    return out


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``q``, the floors of the scaled components, of vectors that codes can be made for."""
    wide = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(_usable(F.col("v")))
    return wide.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale).try_cast("int")).alias("q"))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, q, code, n_distances) of a written table, and the codebooks by part.

    ``code`` is binary, one byte a part; ``n_distances`` says how many exact distances the row took.
    """
    rows = integer_vectors(vectors).where(F.size("q") % parts == 0)
    order = [F.asc_nulls_last("vec_id"), F.asc("q")]
    first = rows.orderBy(*order).limit(1).collect()
    width = len(first[0]["q"]) // parts if first else 1
    bound = math.isqrt((1 << 60) // (width * parts))
    rows = rows.where((F.size("q") == width * parts) & F.forall("q", lambda v: F.abs(v) <= bound))
    seeds = [r["q"] for r in rows.orderBy(*order).limit(entries).select("q").collect()]
    x = np.array(seeds, "i8").reshape(len(seeds), parts, width)
    books = [x[:, p] for p in range(parts)]
    state, folder = rows, None
    before = None
    for k in range(rounds + 1):
        last, (state, now) = folder, written(assigned(state, books, before)) if seeds else (state, None)
        if last:
            removed(rows.sparkSession, last)
        folder = now
        if k < rounds and seeds:
            before, books = books, moved(state, books)
    if not seeds:
        return rows.withColumns({"code": F.lit(b""), "n_distances": F.lit(0).cast("long")}), books
    return state.select("vec_id", "label", "q", "code", "n_distances"), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_errors(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Add ``error``, the squared distances of the parts to their entries, added up."""
    parts, (m, width) = len(books), books[0].shape
    kinds = ", ".join(f"`{c}` {t}" for c, t in coded.dtypes)

    def run(batches):
        table = np.stack(books)
        for batch in batches:
            if len(batch):
                x, code = _column(batch, "q", "i8", parts, width), _column(batch, "code", "u1", parts)
                error = ((x - table[np.arange(parts), code]) ** 2).sum((1, 2))
                yield batch.append_column("error", pa.array(error, pa.int64()))

    return coded.mapInArrow(run, f"{kinds}, error long")


def codes_report(vectors: DataFrame) -> DataFrame:
    """Query op13: codes in hex, errors, errors by label, and the digest of the codebooks."""
    coded, books = vector_codes(vectors)
    rows = with_errors(coded.select("vec_id", "label", "q", "code"), books)
    rows = rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    sums = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return joined_small(rows, sums, "label").select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out; a distance and an index are compared as one number."""
    steps, book = [], "book0"
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} AS (
    SELECT v.row, v.part, min({ENTRIES} * list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) + b.entry) AS best
    FROM parts v JOIN {book} b USING (part) GROUP BY v.row, v.part
)""")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS (
    SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS x FROM (
        SELECT v.part, a.best % {ENTRIES} AS entry, g.i, sum(v.x[g.i]) AS total, count(*) AS n
        FROM near{k} a JOIN parts v ON v.row = a.row AND v.part = a.part JOIN (SELECT unnest(range(1, width + 1)) AS i FROM shape) g ON true
        GROUP BY v.part, a.best % {ENTRIES}, g.i
    ) GROUP BY part, entry
), book{k + 1} AS (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN mean{k} m ON m.part = b.part AND m.entry = b.entry
)""")
            book = f"book{k + 1}"
    return f"""
WITH kept AS (
    SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS row, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), shape AS (
    SELECT CAST(max(len(q)) // {PARTS} AS BIGINT) AS width FROM kept
), parts AS (
    SELECT k.row, p.part, k.q[p.part * s.width + 1 : (p.part + 1) * s.width] AS x
    FROM kept k JOIN (SELECT unnest(range({PARTS})) AS part) p ON true JOIN shape s ON true
), book0 AS (
    SELECT part, row AS entry, x FROM parts WHERE row < {ENTRIES}
), {", ".join(steps)}, made AS (
    SELECT row, string_agg(printf('%02x', CAST(best % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY row
)
SELECT k.vec_id, m.code, m.error, CAST(sum(m.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM {book}) AS codebooks_sha256
FROM kept k JOIN made m USING (row)
"""


SQL = _sql()
