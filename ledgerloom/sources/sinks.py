"""Writing results: folders of CSV and reports; single files are in :mod:`workbook`."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import script_json
from .workbook import cell

_EMBEDDED = re.compile(r"(?:const|let|var)\s+EMBEDDED_DATA\s*=\s*")


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Chosen columns in order, under the names that people read."""
    return df.select(*[F.col(c).alias(label) for c, label in labels.items()])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, written by all executors."""
    df.select(*[cell(F.col(c), k).alias(c) for c, k in df.dtypes]).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def embedded_block(template: str) -> tuple[int, int]:
    """Where the embedded data of a template lies: from its brace to the matching one."""
    m = _EMBEDDED.search(template)
    start = template.find("{", m.end() if m else 0) if m else -1
    if start < 0:
        raise ValueError("template without embedded data")
    token = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?\*/|[{}]", re.DOTALL)
    depth = 0
    for t in token.finditer(template, start):
        depth += (t[0] == "{") - (t[0] == "}")
        if not depth and t[0] == "}":
            return start, t.end()
    raise ValueError("embedded data isn't closed")


def reports(payloads: DataFrame, template: str, payload: str = "payload") -> DataFrame:
    """Add ``html``: the template with each company's payload in place of its embedded data."""
    start, end = embedded_block(template)
    return payloads.withColumn("html", F.concat(F.lit(template[:start]), script_json(F.col(payload)), F.lit(template[end:])))


def unique_names(df: DataFrame, stem: str, tie: str, suffix: str = ".html") -> DataFrame:
    """Add ``file_name``; of stems that are equal but for case, all but the first get a number."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(F.lower(stem)).orderBy(tie))
    return df.withColumn("file_name", F.concat(F.col(stem), F.when(n > 1, F.concat(F.lit("_"), n.cast("string"))).otherwise(F.lit("")), F.lit(suffix)))


def payload_text(data: dict) -> str:
    """A payload as the template holds it: indented JSON that may stand in a script."""
    return json.dumps(data, ensure_ascii=False, indent=2).replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
