"""Filing documents as rows of cells, and the statement items that SQL picks from them.

Python only repairs encodings and cuts a document into its titles, paragraphs and table
rows (:func:`document_rows`); which rows belong to which statement, which columns are the
current and the prior period, which row wins an item and what is netted against it are
DataFrame operations over those rows.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.amounts import missing_items, parse_status, signed_by_item, signed_by_name, won_amount
from ..functions.text import account_label, bound, has_roman_prefix, looked_up, stripped
from ..operators.ordering import materialised

# fixed values: words that titles of statements hold, words before captions, titles that end a statement
TITLES = {"bs": "재무상태표", "is": "손익계산서", "cf": "현금흐름표"}
ATTACHED_TITLE = "재무제표"
NOTES_WORD = "주석"
OTHER_TITLES = ["자본변동표", "결손금처리계산서", "이익잉여금처분계산서", "주석", "외부감사"]
CAPTION_PREFIXES = ["연결", "별도", "개별", "포괄"]
SECTION_WORDS = {"bs": "재무상태표", "is": "손익계산서", "cf": "현금흐름표", "notes": "주석", "audit": "감사보고서"}

_DECLARATION = re.compile(fixed.XML_DECLARATION, re.IGNORECASE)
_PSEUDO_TAG = re.compile(fixed.PSEUDO_TAG)
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<!--.*?-->|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_CELLS = {"TD", "TH", "TE", "TU"}
_HEADS = {"TH", "TU"}
_BLANKS = (" ", "　", "\n", "\r", "\t")
_NO_BREAKS = {10: None, 13: None, 9: None}

_CELL = "text:string,span:int,indent:int,level:int,rows:int,head:boolean"
ROWS = (
    "rcept_no string, pos int, kind string, table_no int, aclass string, in_head boolean, text string, "
    f"cells array<struct<{_CELL}>>, since int, until int"
)


def repaired(raw: bytes) -> str:
    """A document's text: UTF-8, else code page 949 without its untrue declaration, else what can be read."""
    try:
        return bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        text = bytes(raw).decode("cp949")
    except UnicodeDecodeError:
        text = bytes(raw).decode("utf-8", errors="replace")
    return _DECLARATION.sub("", text, count=1)


def _number(text: str | None, default: int) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def cut(text: str) -> list[tuple]:
    """Titles, paragraphs and table rows of a document, in order; broken markup is read as far as it goes.

    A title also tells which rows its parent element holds: those from ``since`` to before ``until``.
    An element that is never closed ends with what is closed around it, or with the document.
    """
    text = _PSEUDO_TAG.sub("", text)
    elements: list[tuple[str, int, list[int]]] = []  # open elements: tag, rows before it, rows of the titles in it
    opened: dict[str, int] = {}  # how many of each tag are open
    ranges: dict[int, list] = {}  # of titles by their row
    out, at, table, depth, head = [], 0, 0, 0, False
    holder: list | None = None  # the text parts of the open title, paragraph or cell
    kind, cells, aclass, attributes, cell_tag, parent = "", None, None, {}, "", None

    def close():
        nonlocal holder
        if holder is None:
            return
        words = html.unescape("".join(holder))
        plain = words.strip()
        if kind in ("TITLE", "P"):
            if kind == "TITLE":
                tag, before, titles = parent or ("", 0, [])
                titles.append(len(out))
                ranges[len(out)] = [before, None]
            out.append((kind, table if depth else None, None, None, plain, []))
        elif cells is not None:
            indent = 0
            if words[:1] in _BLANKS:
                flat = words.translate(_NO_BREAKS)
                indent = len(flat) - len(flat.lstrip(" 　"))
            if attributes:
                span, spanned, level = _number(attributes.get("COLSPAN"), 1), _number(attributes.get("ROWSPAN"), 1), _number(attributes.get("ALEVEL"), -1)
            else:
                span, spanned, level = 1, 1, -1
            cells.append((plain, span, indent, level, spanned, cell_tag in _HEADS))
        holder = None

    for m in _TAG.finditer(text):
        begin, end = m.span()
        if holder is not None:
            holder.append(text[at:begin])
        at = end
        slash, name, inside = m.groups()
        if not name:
            continue
        tag, ends = name.rpartition(":")[2].upper(), bool(slash)
        if tag in ("TITLE", "P") and not (tag == "P" and cells is not None):
            close()
            if not ends:
                holder, kind, parent = [], tag, elements[-1] if elements else None
        elif tag == "TABLE":
            close()
            if ends and cells:
                out.append(("ROW", table, aclass, head, None, cells))
            cells = None
            depth += -1 if ends and depth else (0 if ends else 1)
            if not ends and depth == 1:
                table += 1
                aclass = {k.upper(): a or b for k, a, b in _ATTRIBUTE.findall(inside)}.get("ACLASS")
                head = False
        elif tag == "THEAD":
            head = not ends
        elif tag == "TR" and depth:
            close()
            if cells:
                out.append(("ROW", table, aclass, head, None, cells))
            cells = None if ends else []
        elif tag in _CELLS and cells is not None:
            close()
            if not ends:
                holder, kind, cell_tag = [], "CELL", tag
                attributes = {k.upper(): a or b for k, a, b in _ATTRIBUTE.findall(inside)} if inside else {}
        if not ends:
            if not inside.endswith("/"):
                elements.append((tag, len(out), []))
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag):
            while True:
                was, _, titles = elements.pop()
                opened[was] -= 1
                if was in ("TITLE", "P") or was in _CELLS:
                    close()  # ends with what is closed around it
                for t in titles:
                    ranges[t][1] = len(out)
                if was == tag:
                    break
    close()
    for at, (since, until) in ranges.items():
        ranges[at] = [since, len(out) if until is None else until]
    return [(*row, *ranges.get(i, (None, None))) for i, row in enumerate(out)]


def document_rows(documents: DataFrame, number: str = "rcept_no", content: str = "content") -> DataFrame:
    """One row per title, paragraph and table row of each document; unreadable documents give none."""

    def run(batches):
        for batch in batches:
            rows = []
            for rcept_no, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = cut(repaired(raw)) if raw is not None else []
                except Exception:  # one broken document must not end the job
                    found = []
                rows += [(rcept_no, i, *x) for i, x in enumerate(found)]
                if len(rows) >= _BATCH:
                    yield _as_batch(rows)
                    rows = []
            if rows:
                yield _as_batch(rows)

    return documents.select(F.col(number).cast("string"), content).mapInArrow(run, ROWS)


_BATCH = 10_000
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), None, pa.int32(), pa.int32()]
_CELL_KINDS = {"text": pa.string(), "span": pa.int32(), "indent": pa.int32(), "level": pa.int32(), "rows": pa.int32(), "head": pa.bool_()}


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of :data:`ROWS` as Arrow columns; all cells are one flat table with an offset a row."""
    columns = list(zip(*rows, strict=True))
    flat, offsets = [], []
    for cells in columns[7]:
        offsets.append(None if cells is None else len(flat))
        flat += cells or ()
    parts = list(zip(*flat, strict=True)) or [()] * len(_CELL_KINDS)
    cells = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(parts, _CELL_KINDS.values(), strict=True)], list(_CELL_KINDS))
    lists = pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), cells)
    names = ["rcept_no", "pos", "kind", "table_no", "aclass", "in_head", "text", "cells", "since", "until"]
    return pa.RecordBatch.from_arrays([lists if k is None else pa.array(v, k) for v, k in zip(columns, _KINDS, strict=True)], names)


def repaired_documents(documents: DataFrame, content: str = "content", text: str = "text") -> DataFrame:
    """Each document's text instead of its bytes: valid UTF-8 is decoded by Spark, only other rows reach Python.

    A null document has a null text.
    """
    plain = F.col(content).cast("string")
    valid = F.coalesce(F.is_valid_utf8(plain), F.lit(True))
    good = documents.where(valid).withColumn(text, plain).drop(content)
    kinds = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes if c != content)

    def run(batches):
        for pdf in batches:
            pdf[text] = [repaired(raw) for raw in pdf[content]]
            yield pdf.drop(columns=content)

    return good.unionByName(documents.where(~valid).mapInPandas(run, f"{kinds}, `{text}` string"))


def _packed(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), fixed.LABEL_BLANKS, "")


def caption_section(c: Column) -> Column:
    """bs, is, cf for a caption of an attached statement; else null."""
    text = F.regexp_replace(_packed(c), f"^(?:{'|'.join(CAPTION_PREFIXES)})+", "")
    out = F.lit(None).cast("string")
    for k, word in TITLES.items():
        out = F.when(text.startswith(word), F.lit(k)).otherwise(out)
    return out


def title_mode(c: Column) -> Column:
    """What a title opens: a statement, the attached statements, or something else."""
    text = _packed(c)
    return (
        F.when(text.contains(TITLES["bs"]), "bs").when(text.contains(TITLES["is"]), "is").when(text.contains(TITLES["cf"]), "cf")
        .when(text.contains(ATTACHED_TITLE) & ~text.contains(NOTES_WORD), "attached").otherwise("other")
    )


def _sections_marked(rows: DataFrame) -> DataFrame:
    """Rows with ``mode`` (what the last title opened), ``run`` (titles so far), ``caption``, ``section`` and ``part`` (captions so far).

    A running last title tells the mode; inside attached statements a running last caption
    (a paragraph or a table's first cell) tells the section.
    """
    order = Window.partitionBy("rcept_no").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mode = F.last(F.when(F.col("kind") == "TITLE", title_mode(F.col("text"))), ignorenulls=True).over(upto)
    run = F.count_if(F.col("kind") == "TITLE").over(upto)
    first_cell = F.when((F.col("kind") == "ROW") & (F.row_number().over(Window.partitionBy("rcept_no", "table_no", "kind").orderBy("pos")) == 1), F.get("cells", F.lit(0))["text"])
    caption = caption_section(F.when(F.col("kind") == "P", F.col("text")).otherwise(first_cell))
    marked = rows.withColumns({"mode": mode, "run": run, "caption": caption})
    by_run = Window.partitionBy("rcept_no", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.when(F.col("mode") == "attached", F.last("caption", ignorenulls=True).over(by_run)).when(F.col("aclass") == "FINANCE", F.col("mode"))
    captions = F.count("caption").over(by_run)
    return marked.withColumns({"section": section, "part": captions})


def statement_rows(rows: DataFrame) -> DataFrame:
    """Rows of statements' tables: section, format, table_no, pos, in_head, cells."""
    found = _sections_marked(rows).where("kind = 'ROW' and section in ('bs', 'is', 'cf')")
    return found.select("rcept_no", "section", F.when(F.col("mode") == "attached", "attached").otherwise("finance").alias("format"), "run", "part", "table_no", "pos", "in_head", "cells")


def _columns_of(cells: Column) -> Column:
    """Header cells with the first column that each covers."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,at:int,span:int>>").alias("out"))

    def step(s, c):
        item = F.struct(_packed(c["text"]).alias("text"), s["at"].alias("at"), c["span"].alias("span"))
        return F.struct((s["at"] + c["span"]).alias("at"), F.concat(s["out"], F.array(item)).alias("out"))

    return F.aggregate(cells, start, step)["out"]


def period_plan(cells: Column) -> Column:
    """Struct (cur, prv) of column numbers for a header row of an attached statement; null if it is none."""
    return bound(_columns_of(cells), _plan_of)


def _plan_of(columns: Column) -> Column:
    def spread(kept):
        return F.flatten(F.transform(kept, lambda c: F.sequence(c["at"], c["at"] + c["span"] - 1)))

    def says(c, bracket, word):
        return c["text"].contains(bracket) | c["text"].contains(word)

    current = lambda c: says(c, "(당)", "당기") & ~says(c, "(전)", "전기")
    prior = lambda c: says(c, "(전)", "전기") & ~says(c, "(당)", "당기")
    def role(c):
        return F.when(current(c), "cur").when(prior(c), "prv").otherwise("")

    def by_ordinal(ordinal):
        one, two = F.get(ordinal, F.lit(0)), F.get(ordinal, F.lit(1))
        swapped = (role(one) != role(two)) & ((role(one) == "prv") | (role(two) == "cur"))
        pair = F.when(swapped, F.struct(two.alias("a"), one.alias("b"))).otherwise(F.struct(one.alias("a"), two.alias("b")))
        return F.when(F.size(ordinal) >= 2, bound(pair, lambda p: F.struct(spread(F.array(p["a"])).alias("cur"), spread(F.array(p["b"])).alias("prv"))))

    def by_word(s):
        named = F.struct(spread(s["cur"]).alias("cur"), spread(s["prv"]).alias("prv"))
        return F.when((F.size(s["cur"]) > 0) & (F.size(s["prv"]) > 0), named).otherwise(bound(F.filter(columns, lambda c: c["text"].rlike(fixed.ORDINAL_PERIOD)), by_ordinal))

    return bound(F.struct(F.filter(columns, current).alias("cur"), F.filter(columns, prior).alias("prv")), by_word)


def _first_value(cells: Column, at: Column) -> Column:
    """The first cell of some columns that holds an amount."""
    values = F.transform(at, lambda i: won_amount(F.get(cells, i.cast("int"))["text"]))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _item(section: Column, label: Column) -> Column:
    return F.when(section == "cf", looked_up(fixed.CASH_FLOW_LABELS, label)).otherwise(looked_up(fixed.ACCOUNT_LABELS, label))


def _detail_item(section: Column, label: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, labels in fixed.DETAIL_LABELS.items():
        out = F.when(section == k, looked_up(labels, label)).otherwise(out)
    return out


def labelled_amounts(rows: DataFrame) -> DataFrame:
    """Body rows of the tables that count: label, both periods' amounts as written, item and detail item.

    Statement tables: the first marked table of a title. Attached ones: the first table after a
    caption that has both periods and a known item with an amount.
    """
    table = Window.partitionBy("rcept_no", "table_no")
    label = F.get("cells", F.lit(0))["text"]
    # statements: header spans tell how many columns a period has (two, if nothing tells)
    head = F.max(F.when(F.col("in_head"), F.transform(F.slice("cells", F.lit(2), F.size("cells")), lambda c: c["span"]))).over(table)
    spans = F.when(F.size(head) >= 2, F.struct(F.get(head, F.lit(0)).alias("a"), F.get(head, F.lit(1)).alias("b"))).when(F.size(head) == 1, F.struct(F.get(head, F.lit(0)).alias("a"), F.get(head, F.lit(0)).alias("b"))).otherwise(F.struct(F.lit(2).alias("a"), F.lit(2).alias("b")))
    # attached: the first row that is a plan, header rows first
    # any word or number of a period has one of these signs
    words = F.array_join(F.col("cells")["text"], " ")
    may_be = (F.col("format") == "attached") & (words.contains("당") | words.contains("제"))
    rows = rows.withColumn("plan", F.when(may_be, period_plan(F.col("cells"))))
    ranked = F.min(F.when(F.col("plan").isNotNull(), F.struct((~F.col("in_head")).alias("late"), F.col("pos").alias("pos"), F.col("plan").alias("plan")))).over(table)
    rows = rows.withColumns({"spans": spans, "chosen": ranked})
    body = rows.where(~F.col("in_head") & ((F.col("format") == "finance") | (F.col("chosen").isNotNull() & (~F.col("chosen.late") | (F.col("pos") > F.col("chosen.pos"))))))
    cur_at = F.when(F.col("format") == "finance", F.sequence(F.lit(1), F.col("spans.a"))).otherwise(F.col("chosen.plan.cur"))
    prv_at = F.when(F.col("format") == "finance", F.sequence(F.col("spans.a") + 1, F.col("spans.a") + F.col("spans.b"))).otherwise(F.col("chosen.plan.prv"))
    body = body.withColumns({"label": label, "cur_raw": _first_value(F.col("cells"), cur_at), "prv_raw": _first_value(F.col("cells"), prv_at)}).where("coalesce(label, '') <> ''")
    name = account_label(F.col("label"))
    body = body.withColumn("name", name)
    body = body.withColumns({"item": _item(F.col("section"), F.col("name")), "detail": _detail_item(F.col("section"), F.col("name"))})
    useful = F.max(F.when(F.col("item").isNotNull() & (F.col("cur_raw").isNotNull() | F.col("prv_raw").isNotNull()), 1).otherwise(0)).over(table)
    body = body.withColumn("counts", (F.col("format") == "finance") | (useful == 1)).where("counts")
    first = F.dense_rank().over(Window.partitionBy("rcept_no", "run", "part", "format").orderBy("table_no"))
    return body.withColumn("nth", first).where("nth = 1").select("rcept_no", "section", "format", "table_no", "pos", "label", "name", F.get("cells", F.lit(0))["indent"].alias("indent"), F.get("cells", F.lit(0))["level"].alias("level"), "cur_raw", "prv_raw", "item", "detail")


def _netted(all_: Column, owner: Column) -> Column:
    """The amounts of a detail row less the contra rows that follow it in its table without a gap; amounts are only lowered."""
    after = F.filter(all_, lambda r: r["pos"] > owner["pos"])
    markers, word = F.lit(None).cast("string"), F.lit(None).cast("string")
    for item, (words, own) in fixed.CONTRA_ROWS.items():
        markers = F.when(owner["detail"] == item, F.lit("|".join(words))).otherwise(markers)
        word = F.when(owner["detail"] == item, F.lit(own)).otherwise(word)

    def step(s, r):
        is_contra = s["open"] & F.coalesce(F.rlike(r["name"], markers) & (s["adjacent"] | F.contains(r["name"], word)), F.lit(False))

        def less(x, y):
            return F.when(is_contra & y.isNotNull(), x - F.abs(y)).otherwise(x)

        return F.struct(less(s["cur"], r["cur_raw"]).alias("cur"), less(s["prv"], r["prv_raw"]).alias("prv"), is_contra.alias("open"), F.lit(False).alias("adjacent"))

    start = F.struct(owner["cur_raw"].alias("cur"), owner["prv_raw"].alias("prv"), markers.isNotNull().alias("open"), F.lit(True).alias("adjacent"))
    return F.aggregate(after, start, step)


def statement_items(rows: DataFrame) -> DataFrame:
    """(rcept_no, item, cur, prv): one row per item of each document.

    Statement tables: the first row of an item counts even if it is empty. Attached ones and
    detail accounts: the first row with an amount counts. A table's rows are one bounded array
    (a printed table), from which all three kinds are taken, so the documents are read once.
    """
    amounts = labelled_amounts(statement_rows(rows))
    entry = F.struct("pos", "label", "name", "cur_raw", "prv_raw", "item", "detail")
    tables = amounts.groupBy("rcept_no", "table_no", "format").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    finance = F.col("format") == "finance"

    def named(r):
        cur, prv = (F.when(finance, signed_by_name(r["name"], r[c])).otherwise(signed_by_item(r["item"], r[c])) for c in ("cur_raw", "prv_raw"))
        return F.struct(r["item"].alias("item"), r["pos"].alias("pos"), cur.alias("cur"), prv.alias("prv"))

    def detailed(r):
        return bound(_netted(F.col("all"), r), lambda net: F.struct(r["detail"].alias("item"), r["pos"].alias("pos"), net["cur"].alias("cur"), net["prv"].alias("prv")))

    amount = lambda r: r["cur"].isNotNull() | r["prv"].isNotNull()
    counted = F.transform(F.filter("all", lambda r: r["item"].isNotNull() & (finance | r["cur_raw"].isNotNull() | r["prv_raw"].isNotNull())), named)
    details = F.filter(F.transform(F.filter("all", lambda r: r["detail"].isNotNull()), detailed), amount)
    found = tables.select("rcept_no", "format", F.explode(F.concat(counted, details)).alias("r")).select("rcept_no", "format", "r.*")
    # an attached row without a current amount can still be replaced by a later one that has it
    rank = F.struct((F.col("format") == "attached") & F.col("cur").isNull(), F.col("pos"))
    best = found.groupBy("rcept_no", "item").agg(F.min_by(F.struct("cur", "prv"), rank).alias("v"))
    return best.select("rcept_no", "item", "v.cur", "v.prv")


def parsed_filings(documents: DataFrame) -> DataFrame:
    """One row per document: parse_status, the items of both periods and the missing ones."""
    rows = materialised(document_rows(documents))
    items = statement_items(rows)
    wide = items.groupBy("rcept_no").agg(
        *[F.max(F.when(F.col("item") == i, F.col("cur"))).alias(f"{i}_cur") for i in fixed.ITEMS],
        *[F.max(F.when(F.col("item") == i, F.col("prv"))).alias(f"{i}_prv") for i in fixed.ITEMS],
    )
    tables = statement_rows(rows).where("section in ('bs', 'is')").select("rcept_no").distinct().withColumn("_found", F.lit(True))
    out = documents.select("rcept_no").distinct().join(wide, "rcept_no", "left").join(tables, "rcept_no", "left")
    missing = {s: missing_items({i: F.col(f"{i}_{s}") for i in fixed.STANDARD_ITEMS}) for s in ("cur", "prv")}
    found = F.coalesce("_found", F.lit(False))
    out = out.withColumn("parse_status", parse_status(found, missing["cur"], missing["prv"]))
    return out.withColumns({f"missing_{s}": m for s, m in missing.items()}).drop("_found")


def account_details(rows: DataFrame) -> DataFrame:
    """(rcept_no, item, position, label, level, cur, prv): accounts below each summary row of a table.

    Marked tables state levels: a row of level 0 that names an item opens it, any other row of
    level 0 closes it. Attached ones don't: rows whose (indent, numbered or not) is the table's
    least are of level 0, the others are ranked by indent inside their group, and any row that
    names an item opens it. Numbering thus only tells where groups begin, never how deep a row
    lies. Where numbering alone made rows accounts, the table has no indents, and rows of level 0
    go on with the accounts of the item - unless they have no amount or a Roman numeral, which
    opens another part.
    """
    amounts = labelled_amounts(statement_rows(rows))
    keys = ["rcept_no", "table_no"]
    table = Window.partitionBy(*keys)
    upto = table.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = F.col("format") == "finance"
    numbered = stripped(F.col("label")).rlike(fixed.SUBITEM_PREFIX).cast("int")
    out = amounts.withColumn("key", F.struct(F.col("indent").alias("indent"), numbered.alias("numbered")))
    out = out.withColumn("base", F.min("key").over(table))
    out = out.withColumn("top", F.when(marked, F.coalesce("level", F.lit(0)) <= 0).otherwise(F.col("key") == F.col("base")))
    out = out.withColumn("opens", F.col("item").isNotNull() & (~marked | F.col("top")))
    out = out.withColumns({"grp": F.count_if("top").over(upto), "part": F.count_if("opens").over(upto)})
    depth = F.dense_rank().over(Window.partitionBy(*keys, "grp", "top").orderBy("indent"))
    out = out.withColumn("depth", F.when(marked, F.col("level")).when(~F.col("top"), depth))
    # inside a part: the depth that numbering alone gave last, and whether a row has ended the part
    part = Window.partitionBy(*keys, "part").orderBy("pos")
    flat = F.when(~marked & ~F.col("top") & ~F.col("opens") & (F.col("indent") == F.col("base.indent")), F.col("depth"))
    out = out.withColumn("flat", F.last(flat, ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, -1)))
    empty = F.col("cur_raw").isNull() & F.col("prv_raw").isNull()
    goes_on = ~marked & F.col("flat").isNotNull() & ~empty & ~has_roman_prefix(F.col("label"))
    out = out.withColumn("ends", ~F.col("opens") & F.col("top") & ~goes_on)
    out = out.withColumn("ended", F.count_if("ends").over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("parent", F.max(F.when(F.col("opens"), F.col("item"))).over(Window.partitionBy(*keys, "part")))
    below = out.where("part > 0 and not opens and ended = 0")
    position = F.row_number().over(Window.partitionBy("rcept_no", "parent").orderBy("table_no", "pos")) - 1
    shown = lambda c: F.when(marked, signed_by_name(F.col("name"), F.col(c))).otherwise(F.col(c))
    return below.select(
        "rcept_no", F.col("parent").alias("item"), position.alias("position"), "label", F.when(F.col("top"), F.col("flat")).otherwise(F.col("depth")).cast("int").alias("level"),
        shown("cur_raw").alias("cur"), shown("prv_raw").alias("prv"),
    )


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _row_markup(c: Column) -> Column:
    """A table row's cells; only the tags and spans known here are written."""

    def span(name, n):
        return F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")

    def cell(x):
        tag = F.when(x["head"], "th").otherwise("td")
        return F.concat(F.lit("<"), tag, span("colspan", x["span"]), span("rowspan", x["rows"]), F.lit(">"), _escaped(x["text"]), F.lit("</"), tag, F.lit(">"))

    return F.concat(F.lit("<tr>"), F.concat_ws("", F.transform(c, cell)), F.lit("</tr>"))


def _blocks_markup(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, html) of rows (keys, pos, kind, table_no, text, cells); rows of one table follow each other in one table element."""
    inside = F.col("table_no").isNotNull() & F.col("kind").isin("ROW", "P", "TITLE")
    markup = (
        F.when(F.col("kind") == "ROW", _row_markup(F.col("cells")))
        .when(inside | (F.col("text") == ""), F.lit(""))
        .when(F.col("kind") == "TITLE", F.concat(F.lit('<h4 class="doc-section-title">'), _escaped(F.col("text")), F.lit("</h4>")))
        .otherwise(F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>")))
    )
    # rows of a table are one block, any other block stands alone
    block = F.when(F.col("kind") == "ROW", F.col("table_no")).otherwise(-F.col("pos") - 1)
    lines = blocks.select(*keys, block.alias("_block"), (F.col("kind") == "ROW").alias("_row"), F.struct("pos", markup.alias("m")).alias("_r"))
    made = lines.groupBy(*keys, "_block", "_row").agg(F.array_sort(F.collect_list("_r")).alias("_rs"))
    text = F.concat_ws("", F.transform("_rs", lambda r: r["m"]))
    text = F.when(F.col("_row"), F.concat(F.lit("<table>"), text, F.lit("</table>"))).otherwise(text)
    made = made.select(*keys, F.struct(F.get("_rs", F.lit(0))["pos"].alias("pos"), text.alias("m")).alias("_b"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("_b")), lambda b: b["m"]))
    return made.groupBy(*keys).agg(joined.alias("html"))


def rendered_sections(rows: DataFrame) -> DataFrame:
    """(rcept_no, section, html) of the sections bs, is, cf, notes and audit that a document has.

    The first title with a section's word stands for what its parent element holds: titles,
    paragraphs and tables in order, with their spans, everything else as text. A document
    without a title for a statement may have it in its attached statements: from its caption up
    to the next one. Text outside of a table's rows isn't rendered inside the table.
    """
    rows = materialised(rows)  # used three times, and cut from its documents once
    words = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.lit(w).alias("word")) for k, w in SECTION_WORDS.items()]))
    titles = rows.where("kind = 'TITLE'").select("rcept_no", "pos", "text", "since", "until", words.alias("w"))
    titles = titles.where(F.contains(F.translate("text", " 　", ""), F.col("w.word")))
    first = titles.groupBy("rcept_no", F.col("w.section").alias("section")).agg(F.min_by(F.struct("since", "until"), "pos").alias("r"))
    inside = (F.col("pos") >= F.col("r.since")) & (F.col("pos") < F.col("r.until"))
    titled = rows.join(first, "rcept_no").where(inside).select("rcept_no", "section", "pos", "kind", "table_no", "text", "cells")
    found = attached_blocks(rows).join(first.select("rcept_no", "section"), ["rcept_no", "section"], "left_anti")
    return _blocks_markup(titled.unionByName(found), "rcept_no", "section")


def attached_blocks(rows: DataFrame) -> DataFrame:
    """The caption (as a title) and the table rows of each attached statement, up to the next caption or title."""
    marked = _sections_marked(rows).where("mode = 'attached' and section is not null")
    caption = F.col("caption").isNotNull()
    text = F.when(F.col("kind") == "P", F.col("text")).otherwise(F.get("cells", F.lit(0))["text"])
    title = marked.where(caption).select("rcept_no", "section", F.col("pos"), F.lit("TITLE").alias("kind"), F.lit(None).cast("int").alias("table_no"), text.alias("text"), F.array().cast(f"array<struct<{_CELL}>>").alias("cells"))
    # a table whose first cell is the caption is the title itself
    own = F.max(caption & (F.col("kind") == "ROW")).over(Window.partitionBy("rcept_no", "table_no", "kind"))
    body = marked.withColumn("_own", own).where("kind = 'ROW' and not _own").select("rcept_no", "section", "pos", "kind", "table_no", "text", "cells")
    return title.unionByName(body)


def table_grid(rows: DataFrame) -> DataFrame:
    """(rcept_no, table_no, line, col, text): each cell's text on every line and column that it spans, as a reader sees the table.

    Lines are folded in order by SQL functions; the state holds, for each column, how many more
    lines the cell above it reaches and its text. A table is a bounded array (a printed table).
    """
    table = rows.where("kind = 'ROW'").groupBy("rcept_no", "table_no").agg(F.array_sort(F.collect_list(F.struct("pos", "cells"))).alias("lines"))
    held = "array<struct<col:int,left:int,text:string>>"
    start = F.struct(F.array().cast(held).alias("held"), F.array().cast(f"array<{held}>").alias("done"))

    def line(s, r):
        return bound(F.filter(s["held"], lambda h: h["left"] > 0), lambda taken: bound(F.array_sort(F.concat(taken, fresh(taken, r))), lambda now: after(s, now)))

    def fresh(taken, r):
        def place(t, c):
            # the first column from `u.at` on that no cell from above holds
            free = lambda at: F.aggregate(taken, at, lambda a, h: F.when(h["col"] == a, a + 1).otherwise(a))  # noqa: E731  (columns ascend)

            def add(u, _):
                new = lambda at: F.struct(at.alias("col"), F.greatest(c["rows"], F.lit(1)).alias("left"), c["text"].alias("text"))
                return bound(free(u["at"]), lambda at: F.struct((at + 1).alias("at"), F.concat(u["new"], F.array(new(at))).alias("new")))

            return F.aggregate(F.sequence(F.lit(1), F.greatest(c["span"], F.lit(1))), t, add)

        return F.aggregate(r["cells"], F.struct(F.lit(0).alias("at"), F.array().cast(held).alias("new")), place)["new"]

    def after(s, now):
        later = F.transform(now, lambda h: F.struct(h["col"].alias("col"), (h["left"] - 1).alias("left"), h["text"].alias("text")))
        return F.struct(later.alias("held"), F.concat(s["done"], F.array(now)).alias("done"))

    grid = table.select("rcept_no", "table_no", F.posexplode(F.aggregate("lines", start, line)["done"]).alias("line", "cells"))
    return grid.select("rcept_no", "table_no", "line", F.explode("cells").alias("c")).select("rcept_no", "table_no", "line", "c.col", "c.text")


def section_html(rows: DataFrame) -> DataFrame:
    """(rcept_no, section, html): only the tables of each statement as plain markup, cells escaped."""
    found = statement_rows(rows)

    def cell(tag):
        return lambda c: F.concat(F.lit(f"<{tag}"), F.when(c["span"] > 1, F.concat(F.lit(' colspan="'), c["span"].cast("string"), F.lit('"'))).otherwise(F.lit("")), F.lit(">"), _escaped(c["text"]), F.lit(f"</{tag}>"))

    body = F.when(F.col("in_head"), F.concat_ws("", F.transform("cells", cell("th")))).otherwise(F.concat_ws("", F.transform("cells", cell("td"))))
    lines = found.select("rcept_no", "section", F.struct("table_no", "pos", F.concat(F.lit("<tr>"), body, F.lit("</tr>")).alias("line")).alias("r"))
    tables = lines.groupBy("rcept_no", "section", "r.table_no").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    table = F.concat(F.lit("<table>"), F.concat_ws("", F.transform("rs", lambda r: r["line"])), F.lit("</table>"))
    return tables.groupBy("rcept_no", "section").agg(F.array_sort(F.collect_list(F.struct("table_no", table.alias("t")))).alias("ts")).select("rcept_no", "section", F.concat_ws("\n", F.transform("ts", lambda t: t["t"])).alias("html"))


def details_with_reasons(results: DataFrame, documents: DataFrame) -> DataFrame:
    """(result_id, n_details, reason): how many accounts each result's filing gives, or why it gives none.

    ``results`` has id and rcept_no; ``documents`` rcept_no, kind (XML, PDF) and content. Reasons:
    ``no_filing``, ``no_document``, ``pdf_only``, ``not_read`` (nothing could be cut from it) and
    ``no_details``. The documents are read once; a filing of several results is cut once.
    """
    wanted = results.where("coalesce(rcept_no, '') <> ''").select("rcept_no").distinct()
    found = documents.join(wanted, "rcept_no", "left_semi")
    kinds = found.groupBy("rcept_no").agg(F.max(F.col("kind") == "XML").alias("_xml"))
    rows = materialised(document_rows(found.where("kind = 'XML'")))
    read = rows.select("rcept_no").distinct().withColumn("_read", F.lit(True))
    counts = account_details(rows).groupBy("rcept_no").agg(F.count(F.lit(1)).alias("n_details"))
    known = kinds.join(read, "rcept_no", "left").join(counts, "rcept_no", "left")
    reason = (
        F.when(F.coalesce("rcept_no", F.lit("")) == "", "no_filing").when(F.col("_xml").isNull(), "no_document").when(~F.col("_xml"), "pdf_only")
        .when(F.col("_read").isNull(), "not_read").when(F.col("n_details").isNull(), "no_details")
    )
    out = results.select(F.col("id").alias("result_id"), "rcept_no").join(known, "rcept_no", "left")
    return out.select("result_id", F.coalesce("n_details", F.lit(0)).cast("bigint").alias("n_details"), reason.alias("reason"))
