"""Landed files as a planned source: ``spark.read.format("landed")`` and ``spark.readStream.format("landed")``.

Files lie in ``year=<year>/`` or ``unit=<unit>/`` folders. Planning lists them, leaves out those
that pushed filters on ``part`` (the folder's value) exclude, and deals the rest to partitions of
about equal bytes; each task opens its own files. As a stream, an offset is the name of the last
file, so a query that starts again goes on behind the files that it has committed.

Options: ``path``; ``kind`` (``pages``: JSON pages of items, ``codes``: zipped XML lists,
``sheets``: rows of the first sheet by position, ``lists``: HTML list pages); ``fields`` (comma-
separated; of pages, codes and sheets); ``bytes`` of a partition. Every row also has ``part``,
``file`` and ``position`` (from 0 in its file). Pushed filters need the setting
``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .landed import SHEET, _sheet_rows
from .workbook import store_of

BYTES = 16 << 20
_CODES = ["corp_code", "corp_name", "stock_code", "modify_date"]
_LISTS = ["corp_code", "listed_name"]
_SUFFIX = {"pages": ".json", "codes": ".zip", "sheets": ".xlsx", "lists": ".html"}
_LINK = re.compile(r"openCorpInfo(?:New)?\('(\d{8})'[^>]*>([^<]*)<")  # fixed value: how list pages name a company


@dataclass
class Files(InputPartition):
    files: list[tuple[str | None, str]]  # the folder's value and the path


def listed(path: str, kind: str) -> list[tuple[str | None, str, int]]:
    """(part, path, bytes) of all files of a kind, by name."""
    store, place = store_of(path)
    out = []
    for info in store.get_file_info(fs.FileSelector(place, recursive=True)):
        name = info.path.rsplit("/", 1)[-1]
        if info.type == fs.FileType.File and name.lower().endswith(_SUFFIX[kind]) and not name.startswith(("_", ".")):
            part = re.search(r"/(?:year|unit)=([^/]+)/", info.path)
            out.append((unquote(part[1]) if part else None, info.path, info.size or 0))
    return sorted(out, key=lambda f: f[1])


def dealt(files: list[tuple[str | None, str, int]], size: int) -> list[Files]:
    """Partitions of about ``size`` bytes, each with at least one file."""
    out: list[Files] = []
    filled = size
    for part, path, n in files:
        if filled + n > size and (filled or not out):
            out.append(Files([]))
            filled = 0
        out[-1].files.append((part, path))
        filled += n
    return out


def _items(raw: bytes, fields: list[str]) -> Iterator[tuple]:
    """Items of a page: a list, one object, or none."""
    body = json.loads(raw).get("response", {}).get("body", {})
    items = (body.get("items") or {}).get("item") if isinstance(body.get("items"), dict) else None
    for item in items if isinstance(items, list) else [items] if items else []:
        yield tuple(None if item.get(f) is None else str(item[f]) for f in fields)


def _codes(raw: bytes, fields: list[str]) -> Iterator[tuple]:
    """Entries of the first XML file of a zipped list; those without a code are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
        if name is None:
            return
        with z.open(name) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == "list":
                    values = [(node.findtext(x) or "").strip() for x in fields]
                    if values[0]:
                        yield tuple(v or None for v in values)
                    node.clear()


def _rows(raw: bytes, fields: list[str]) -> Iterator[tuple]:
    """Body rows of a sheet by position; another number of columns is an error, rows without a first cell are left out."""
    header, *body = _sheet_rows(raw) or [[]]
    if len(header) != len(fields):
        raise ValueError(f"{len(header)} columns instead of {len(fields)}")
    for r in body:
        values = [(x or "").strip() or None for x in (r + [None] * len(fields))[: len(fields)]]
        if values[0]:
            yield tuple(values)


def _links(raw: bytes, fields: list[str]) -> Iterator[tuple]:
    for code, name in _LINK.findall(raw.decode("utf-8", errors="replace")):
        yield code, name.strip()


_PARSERS = {"pages": _items, "codes": _codes, "sheets": _rows, "lists": _links}


class _Read:
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "pages")
        self.fields, self.size = _fields(options), int(options.get("bytes", BYTES))

    def read(self, partition: Files) -> Iterator[tuple]:
        parse = _PARSERS[self.kind]
        for part, path in partition.files:
            store, place = store_of(self.path)
            with store.open_input_stream(path) as f:
                raw = f.read()
            name = path.removeprefix(place.rstrip("/") + "/")
            for k, values in enumerate(parse(raw, self.fields)):
                yield (part, name, k, *values)


def _fields(options: dict) -> list[str]:
    known = {"codes": _CODES, "lists": _LISTS, "sheets": SHEET}
    return [f.strip() for f in options["fields"].split(",")] if options.get("fields") else known[options.get("kind", "pages")]


class PageReader(_Read, DataSourceReader):
    """Plans the files that filters on ``part`` leave."""

    def __init__(self, options: dict):
        _Read.__init__(self, options)
        self.tests: list = []

    def pushFilters(self, filters):
        """Comparisons of ``part`` with values are taken; all others are left to Spark."""
        kinds = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
        for f in filters:
            if type(f) in kinds and tuple(f.attribute) == ("part",):
                self.tests.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = [f for f in listed(self.path, self.kind) if all(f[0] is not None and test(f[0], value) for test, value in self.tests)]
        return dealt(files, self.size) or [Files([])]


class PageStream(_Read, DataSourceStreamReader):
    """Reads files as they land; names must grow, as those of numbered pages do."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path, self.kind)
        return {"after": files[-1][1] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in listed(self.path, self.kind) if start["after"] < f[1] <= end["after"]], self.size) or [Files([])]

    def commit(self, end: dict) -> None:
        """Files stay where they landed."""


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> T.StructType:
        columns = [("part", T.StringType()), ("file", T.StringType()), ("position", T.LongType()), *[(f, T.StringType()) for f in _fields(self.options)]]
        return T.StructType([T.StructField(n, t) for n, t in columns])

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
