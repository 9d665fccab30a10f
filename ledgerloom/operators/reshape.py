"""Long and wide forms of results and yearly snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import text_map

STATEMENT_OF = {item: statement for statement, items in fixed.STATEMENTS.items() for item in items}
LABEL_OF = {item: label for items in fixed.STATEMENTS.values() for item, label in items.items()}


def statement_of(item: Column) -> Column:
    return F.try_element_at(text_map(STATEMENT_OF), item)


def item_label(item: Column) -> Column:
    return F.try_element_at(text_map(LABEL_OF), item)


def unpivoted(df: DataFrame, keys: list[str], items: list[str], suffix: str = "") -> DataFrame:
    """One row per row and item, in the items' order (``position``); null amounts keep their rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(i).alias("item"), F.col(f"{i}{suffix}").cast("bigint").alias("amount")) for k, i in enumerate(items)])
    return df.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.position", "e.item", "e.amount")


def selection_rows(results: DataFrame, details: DataFrame | None = None, keys: tuple[str, ...] = ("id", "corp_name")) -> DataFrame:
    """Long form of results: each summary row, then the accounts below it in document order.

    ``details`` (id, item, position, label, level, amount) has the accounts of filings.
    """
    summary = unpivoted(results, list(keys), fixed.SELECTION_ITEMS, "_cur")
    rows = summary.select(
        *keys, statement_of(F.col("item")).alias("statement"), "position", F.lit(0).alias("child"), F.lit(None).cast("string").alias("parent"),
        item_label(F.col("item")).alias("account"), F.lit(0).alias("level"), "amount", "item",
    )
    if details is not None:
        places = {i: k for k, i in enumerate(fixed.SELECTION_ITEMS)}
        place = F.try_element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), F.col("item"))
        below = details.join(results.select(*keys), "id").select(
            *keys, statement_of(F.col("item")).alias("statement"), place.alias("position"), (F.col("position") + 1).cast("int").alias("child"),
            item_label(F.col("item")).alias("parent"), F.col("label").alias("account"), "level", "amount", "item",
        )
        rows = rows.unionByName(below)
    return rows


def history_rows(snapshots: DataFrame, names: DataFrame) -> DataFrame:
    """Long form of yearly snapshots with the company's name; snapshots without a company keep a null name."""
    items = [i for items in fixed.STATEMENTS.values() for i in items]
    rows = unpivoted(snapshots, ["result_id", "fiscal_year"], items)
    named = rows.join(names.select(F.col("id").alias("result_id"), "corp_name"), "result_id", "left")
    return named.select("result_id", "corp_name", "fiscal_year", statement_of(F.col("item")).alias("statement"), "position", item_label(F.col("item")).alias("account"), "amount")


def selection_size(results: DataFrame, details: DataFrame) -> DataFrame:
    """Rows that the long form will have."""
    both = results.select(F.lit(len(fixed.SELECTION_ITEMS)).cast("long").alias("n")).unionAll(details.select(F.lit(1).cast("long").alias("n")))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"))


def by_year(rows: DataFrame, keys: list[str], years: list[str], amount: str = "amount") -> DataFrame:
    """Wide form: a column per year."""
    return rows.groupBy(*keys).pivot("fiscal_year", years).agg(F.max(amount))
