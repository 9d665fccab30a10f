"""Workbooks and CSV files of any table without passing rows through the driver.

Rows are range-sorted, and Spark's functions write each row's markup with its place in the
whole order. A task deflates the markup of its partition to raw segments that end on a byte
(a full flush), with their checksums and lengths; segments can be joined as they are, and the
checksum of the whole follows from those of the segments. What reaches the driver are these
few numbers per partition. One task then copies the finished bytes behind each other, since
the format is one file; rows are neither parsed nor compressed again. The number of rows is
known from counts before anything is written. Segments are removed at the end, also when a
task fails, and a file appears under its name only when it is complete.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import without_controls
from ..operators.ordering import materialised, ranked, shared_folder

SHEET_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: the header row: bold, a thin line around it, centred at the top
_STYLES = (
    f'{_XML}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills>'
    '<borders count="2"><border/><border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="2"><xf/><xf fontId="1" borderId="1" applyFont="1" applyBorder="1" applyAlignment="1"><alignment horizontal="center" vertical="top"/></xf></cellXfs></styleSheet>'
)


class TooManyRows(ValueError):
    """More rows than a sheet can hold."""


# ---- checksums of joined parts

_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo the checksum's; the highest bit is the constant."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        a = a >> 1 ^ (_POLYNOMIAL if a & 1 else 0)
        b = b << 1 & 0xFFFFFFFF
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two parts behind each other, of which the second has ``length`` bytes."""
    shift, power, bits = 0x80000000, 0x00800000, length  # 1 and x**8
    while bits:
        if bits & 1:
            shift = _times(shift, power)
        power, bits = _times(power, power), bits >> 1
    return _times(first, shift) ^ second


# ---- cells


def cell(c: Column, kind: str) -> Column:
    """What a sheet shows: blanks for null and NaN, words for infinities, texts without control signs."""
    if kind in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c), None).when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("string"))
    return without_controls(c.cast("string"))


def column_name(k: int) -> str:
    out, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _row_markup(df: DataFrame, row: Column) -> Column:
    """A row's markup; ``row`` is its number in the sheet."""
    number, cells = row.cast("string"), []
    for k, (name, kind) in enumerate(df.dtypes):
        shown = cell(F.col(f"`{name}`"), kind)
        place = F.concat(F.lit(f'<c r="{column_name(k)}'), number)
        text = F.concat(place, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), _escaped(shown), F.lit("</t></is></c>"))
        if kind in _NUMERIC or kind.startswith("decimal"):
            text = F.when(shown.isin("inf", "-inf"), text).otherwise(F.concat(place, F.lit('"><v>'), shown, F.lit("</v></c>")))
        cells.append(F.when(shown.isNull() | (shown == ""), "").otherwise(text))
    return F.concat(F.lit('<row r="'), number, F.lit('">'), *cells, F.lit("</row>"))


def _csv_line(df: DataFrame) -> Column:
    """A CSV line; texts with separators, quotes or line ends are quoted."""
    fields = []
    for name, kind in df.dtypes:
        shown = F.coalesce(cell(F.col(f"`{name}`"), kind), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(shown, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(F.when(shown.rlike('[",\r\n]'), quoted).otherwise(shown))
    return F.concat(F.concat_ws(",", *fields), F.lit("\n"))


# ---- segments


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    if path.startswith("file:/"):
        path = "file:///" + path[5:].lstrip("/")
    elif "://" not in path:
        path = os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def _placed(df: DataFrame, keys: list, most: int, split: bool, name: str) -> tuple[DataFrame, int]:
    """The rows in order with ``_sheet`` and ``_row`` (its number there, the header is 1), and how many rows there are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mono = F.monotonically_increasing_id()
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": mono.bitwiseAND(F.lit((1 << 33) - 1))})
    rows = materialised(rows)
    at, before = 0, []
    for part, count in sorted(map(tuple, rows.groupBy("_part").agg(F.count(F.lit(1))).collect())):  # one row per partition
        before.append((part, at))
        at += count
    if at > most and not split:
        raise TooManyRows(f"{name}: {at} rows; a sheet holds {most}")
    starts = df.sparkSession.createDataFrame(before, "_part int, _before long")
    place = F.col("_before") + F.col("_at")
    rows = rows.join(F.broadcast(starts), "_part").withColumns({"_sheet": F.floor(place / most), "_row": place % most + 2})
    return rows.drop("_at", "_before"), at


def _segments(lines: DataFrame, folder: str, deflate: bool) -> list:
    """Write the ``_text`` of sorted partitions as files; (sheet, part, file, crc, size, packed) of each, in order."""

    def run(batches):
        store, place = store_of(folder)
        store.create_dir(place, recursive=True)
        done, now, out, pack = [], None, None, None

        def close():
            if now is not None:
                last = pack.flush(zlib.Z_FULL_FLUSH) if deflate else b""
                out.write(last)
                out.close()
                now[5] += len(last)
                done.append(tuple(now))

        for batch in batches:
            part, sheet, text = (batch.column(c) for c in ("_part", "_sheet", "_text"))
            at, sheets = 0, sheet.to_pylist()
            while at < len(batch):
                end = at + 1
                while end < len(batch) and sheets[end] == sheets[at]:
                    end += 1
                if now is None or now[0] != sheets[at]:
                    close()
                    # a second attempt of a task writes files of its own; only those that are reported are read
                    file = f"{place}/{uuid.uuid4().hex}"
                    now, out, pack = [sheets[at], part[at].as_py(), file, 0, 0, 0], store.open_output_stream(file), zlib.compressobj(6, zlib.DEFLATED, -15)
                raw = "".join(text.slice(at, end - at).to_pylist()).encode()
                packed = pack.compress(raw) if deflate else raw
                out.write(packed)
                now[3], now[4], now[5] = zlib.crc32(raw, now[3]), now[4] + len(raw), now[5] + len(packed)
                at = end
        close()
        names = [("sheet", pa.int64()), ("part", pa.int64()), ("file", pa.string()), ("crc", pa.int64()), ("size", pa.int64()), ("packed", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, (_, t) in enumerate(names)], [n for n, _ in names])

    made = lines.select("_part", "_sheet", "_text").mapInArrow(run, "sheet long, part long, file string, crc long, size long, packed long")
    return sorted(map(tuple, made.collect()))  # a few numbers per partition


class _Entry:
    """A file of the archive: bytes at hand and segments by name, all deflated, with checksum and sizes."""

    def __init__(self, name: str):
        self.name, self.pieces, self.crc, self.size, self.packed = name.encode(), [], 0, 0, 0

    def text(self, text: str, last: bool = False) -> None:
        raw, pack = text.encode(), zlib.compressobj(6, zlib.DEFLATED, -15)
        piece = pack.compress(raw) + pack.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
        self._add(piece, zlib.crc32(raw), len(raw), len(piece))

    def segment(self, file: str, crc: int, size: int, packed: int) -> None:
        self._add(file, crc, size, packed)

    def _add(self, piece, crc: int, size: int, packed: int) -> None:
        self.crc = joined_crc(self.crc, crc, size)
        self.size, self.packed = self.size + size, self.packed + packed
        self.pieces.append(piece)

    def headers(self, at: int) -> tuple[bytes, bytes]:
        """The header before the entry and the one in the directory; sizes beyond 32 bits go to the extra field."""
        big = [v for v in (self.size, self.packed, at) if v >= 0xFFFFFFFF]
        small = [min(v, 0xFFFFFFFF) for v in (self.size, self.packed, at)]
        both = any(v >= 0xFFFFFFFF for v in (self.size, self.packed))
        local_extra = struct.pack("<HHQQ", 1, 16, self.size, self.packed) if both else b""
        sizes = (0xFFFFFFFF, 0xFFFFFFFF) if both else (small[1], small[0])
        if both:
            big = [self.size, self.packed] + [v for v in (at,) if v >= 0xFFFFFFFF]
        extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
        version = 45 if big or both else 20
        common = struct.pack("<HHHHHIII", version, 0x0800, 8, 0, 0x21, self.crc, *sizes)
        local = b"PK\x03\x04" + common + struct.pack("<HH", len(self.name), len(local_extra)) + self.name + local_extra
        central = b"PK\x01\x02" + struct.pack("<H", version) + common + struct.pack("<HHHHHII", len(self.name), len(extra), 0, 0, 0, 0, small[2]) + self.name + extra
        return local, central


def _archive(entries: list[_Entry]) -> list:
    """The pieces of a zip file: bytes at hand, and names of segment files."""
    out, at, directory = [], 0, b""
    for e in entries:
        local, central = e.headers(at)
        out += [local, *e.pieces]
        at += len(local) + e.packed
        directory += central
    n, end = len(entries), b""
    if at + len(directory) >= 0xFFFFFFFF or n >= 0xFFFF:
        end += b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at)
        end += b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(directory), 1)
    end += b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), len(directory), min(at, 0xFFFFFFFF), 0)
    return [*out, directory, end]


def _join(spark: SparkSession, pieces: list, path: str) -> None:
    """One task copies the pieces behind each other; the file gets its name when it is whole."""

    def run(batches):
        for _ in batches:
            pass
        store, place = store_of(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        draft = f"{place}.{uuid.uuid4().hex}.draft"
        with store.open_output_stream(draft) as out:
            for piece in pieces:
                if isinstance(piece, bytes):
                    out.write(piece)
                    continue
                with store.open_input_stream(piece) as source:
                    while block := source.read(1 << 20):
                        out.write(block)
        if store.get_file_info(place).type != fs.FileType.NotFound:
            store.delete_file(place)
        store.move(draft, place)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    spark.range(1, numPartitions=1).mapInArrow(run, "n long").collect()


def _remove(folder: str) -> None:
    store, place = store_of(folder)
    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)


def write_workbook(sheets: dict[str, tuple[DataFrame, list]], path: str, split: bool = False, most: int = SHEET_ROWS - 1) -> None:
    """Write one workbook of sheets, each a table and the keys of its order.

    A sheet holds ``most`` rows below its header; a table with more is refused before anything
    is written, or with ``split`` goes on in further sheets of the same name with a number.
    ``path`` must be in a store that all executors reach.
    """
    spark = next(iter(sheets.values()))[0].sparkSession
    folder = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    placed = {name: _placed(df, keys, most, split, name) for name, (df, keys) in sheets.items()}
    try:
        entries, names = [], []
        for k, (name, (df, _)) in enumerate(sheets.items()):
            rows, count = placed[name]
            texts = rows.withColumn("_text", _row_markup(df, F.col("_row")))
            found = _segments(texts, f"{folder}/{k}", True)
            header = "".join(f'<c r="{column_name(i)}1" t="inlineStr" s="1"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for i, c in enumerate(df.columns))
            for number in range(max(1, -(-count // most))):
                names.append(name if not number else f"{name} ({number + 1})")
                entry = _Entry(f"xl/worksheets/sheet{len(names)}.xml")
                entry.text(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData><row r="1">{header}</row>')
                for sheet, _, *segment in found:
                    if sheet == number:
                        entry.segment(*segment)
                entry.text("</sheetData></worksheet>", last=True)
                entries.append(entry)
        for name, text in _frame(names):
            entry = _Entry(name)
            entry.text(text, last=True)
            entries.append(entry)
        _join(spark, _archive(entries[-len(_frame(names)) :] + entries[: -len(_frame(names))]), path)
    finally:
        _remove(folder)


def _frame(names: list[str]) -> list[tuple[str, str]]:
    """The parts of a workbook besides its sheets."""
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
    sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
    links = "".join(f'<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
    return [
        ("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>'),
        ("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>'),
        ("xl/styles.xml", _STYLES),
    ]


def write_csv_file(df: DataFrame, path: str, keys: list, most: int = SHEET_ROWS - 1) -> None:
    """Write one CSV file that spreadsheet programs read as UTF-8; checked to fit a sheet, like a workbook's."""
    folder = f"{shared_folder(df.sparkSession)}/segments-{uuid.uuid4().hex}"
    rows, _ = _placed(df, keys, most, False, "csv")
    header = io.StringIO()
    pd.DataFrame(columns=df.columns).to_csv(header, index=False)
    try:
        found = _segments(rows.withColumn("_text", _csv_line(df)), folder, False)
        _join(df.sparkSession, [b"\xef\xbb\xbf" + header.getvalue().encode(), *[file for _, _, file, *_ in found]], path)
    finally:
        _remove(folder)


def put_files(files: DataFrame, folder: str) -> int:
    """Write the ``content`` of each row to its ``path`` below a folder; how many there were. A row written twice is the same file."""

    def run(batches):
        store, place = store_of(folder)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                file = f"{place}/{path}"
                store.create_dir(file.rpartition("/")[0], recursive=True)
                draft = f"{file}.{uuid.uuid4().hex}.draft"
                with store.open_output_stream(draft) as out:
                    out.write(content)
                if store.get_file_info(file).type != fs.FileType.NotFound:
                    store.delete_file(file)
                store.move(draft, file)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a workbook: sheet (name), row and col (from 1 and 0), value; inline and shared texts, and numbers as they stand.

    One task lists the sheets, then each sheet is a task's, which reads only that part of the
    file, as a stream. ``path`` is a file in a store that all executors reach, or a pattern.
    """

    def listed(batches):
        for pdf in batches:
            for file in pdf["path"]:
                store, place = store_of(file)
                with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as z:
                    found = _targets(z)
                yield pd.DataFrame({"path": [file] * len(found), "sheet": [n for n, _ in found], "target": [t for _, t in found]})

    def run(batches):
        for batch in batches:
            for file, sheet, target in zip(*(batch.column(c).to_pylist() for c in ("path", "sheet", "target")), strict=True):
                store, place = store_of(file)
                with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as z:
                    yield from _cells(z, sheet, target)

    files = spark.read.format("binaryFile").load(path).select("path")
    sheets = materialised(files.mapInPandas(listed, "path string, sheet string, target string"))
    # places in a global order deal the sheets evenly; a hash of their names would put several into one task
    order = ranked(sheets, ["path", "target"]).withColumn("place", F.col("place") - 1)
    n = max(1, min(order.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return order.repartitionById(n, (F.col("place") % n).cast("int")).mapInArrow(run, "sheet string, row long, col int, value string")


def _targets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """The names of a workbook's sheets and of their parts in the archive."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return [(sheet.get("name"), "xl/" + targets[sheet.get(f"{{{_REL}}}id")].removeprefix("/xl/")) for sheet in book.iter(f"{{{_MAIN}}}sheet")]


def _cells(z: zipfile.ZipFile, name: str, target: str, size: int = 50_000) -> Iterable[pa.RecordBatch]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.itertext()) for t in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    columns: dict[str, int] = {}  # of letters
    rows, cols, values = [], [], []

    def batch() -> pa.RecordBatch:
        kinds = [("sheet", pa.string(), [name] * len(rows)), ("row", pa.int64(), rows), ("col", pa.int32(), cols), ("value", pa.string(), values)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in kinds], [n for n, _, _ in kinds])

    with z.open(target) as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag != f"{{{_MAIN}}}row":
                continue
            for c in node:
                ref = c.get("r")
                letters = ref.rstrip("0123456789")
                if letters not in columns:
                    col = 0
                    for x in letters:
                        col = col * 26 + ord(x) - 64
                    columns[letters] = col - 1
                value = "".join(c.itertext())
                rows.append(int(ref[len(letters) :]))
                cols.append(columns[letters])
                values.append(shared[int(value)] if c.get("t") == "s" else value)
            node.clear()
            if len(rows) >= size:
                yield batch()
                rows, cols, values = [], [], []
    yield batch()
