"""Amounts, dates and ratios as Column expressions. Money is in won, as long."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import account_label, bound, stripped


def whole_number(c: Column) -> Column:
    """A number of a text, cut towards zero; null for blank or bad text and beyond 64 bits."""
    text = F.nullif(stripped(c.cast("string")), F.lit(""))
    # decimals keep what a double would round; a double reads forms such as 1e9
    return F.coalesce(text.try_cast("decimal(38,10)").try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def won_amount(c: Column) -> Column:
    """The amount of a statement's cell: rule signs dropped, dashes are zero, parentheses negative."""

    def without_rules(raw: Column) -> Column:
        edges = F.regexp_replace(raw, f"^[{fixed.RULE_CHARS}]+|[{fixed.RULE_CHARS}]+$", "")
        return F.when(raw.rlike(f"[{fixed.RULE_CHARS}]"), stripped(edges)).otherwise(raw)

    def amount(raw: Column) -> Column:
        bracketed = raw.startswith("(") & raw.endswith(")")
        body = F.regexp_replace(F.when(bracketed, F.regexp_replace(raw, r"^\(|\)$", "")).otherwise(raw), r"(?U)[,\s]", "")
        zero = F.lit(0).cast("decimal(20,0)")
        value = bound(body, lambda x: F.when(x.isin(fixed.ZERO_AMOUNTS), zero).otherwise(F.nullif(x, F.lit("")).try_cast("decimal(20,0)")))
        return F.when(bracketed, -value).otherwise(value).try_cast("bigint")

    return bound(bound(stripped(F.coalesce(c, F.lit(""))), without_rules), amount)


def signed_by_label(label: Column, value: Column) -> Column:
    """Rows that are named as a loss first hold losses as positive numbers: they are turned."""
    return bound(account_label(label), lambda name: signed_by_name(name, value))


def signed_by_name(name: Column, value: Column) -> Column:
    """The same for a label that :func:`account_label` has made a name."""
    loss, gain = F.instr(name, "손실"), F.instr(name, "이익")
    return F.when((loss > 0) & ((gain == 0) | (loss < gain)), -value).otherwise(value)


def signed_by_item(item: Column, value: Column) -> Column:
    """Attached statements: costs are magnitudes, everything else keeps its sign."""
    return F.when(item.isin("cogs", "sga"), F.abs(value)).otherwise(value)


def first_amount(*cells: Column) -> Column:
    values = F.transform(F.array(*cells), won_amount)
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def missing_items(values: dict[str, Column]) -> Column:
    """The names whose value is null, in order."""
    return F.array_compact(F.array(*[F.when(v.isNull(), F.lit(k)) for k, v in values.items()]))


def parse_status(found_table: Column, missing_cur: Column, missing_prv: Column) -> Column:
    return F.when(~found_table | (F.size(missing_cur) > 0) | (F.size(missing_prv) > 0), F.lit("PARTIAL")).otherwise(F.lit("OK"))


def fiscal_date(raw: Column) -> Column:
    """YYYY-MM-DD of a report's period end attribute, or null."""
    pattern = r'AUNIT="PERIODTO"\s+AUNITVALUE="(\d{4})(\d{2})(\d{2})"'
    year = F.regexp_extract(raw, pattern, 1)
    return F.when(year != "", F.concat_ws("-", year, F.regexp_extract(raw, pattern, 2), F.regexp_extract(raw, pattern, 3)))


def filing_date(rcept_no: Column) -> Column:
    return F.when(rcept_no.rlike(r"^\d{8}"), F.substring(rcept_no, 1, 8))


def is_stale(date: Column, today: Column, days: int = 365) -> Column:
    """No filing, or the last one is older than ``days`` before today."""
    return F.coalesce(date < F.date_format(F.date_sub(today, days), "yyyyMMdd"), F.lit(True))


def history_start(today: Column, years: int) -> Column:
    return F.make_date(F.year(today) - F.lit(years // 2 + 2), F.lit(1), F.lit(1))


def default_years(today: Column) -> Column:
    return F.transform(F.sequence(F.year(today) - 3, F.year(today)), lambda y: y.cast("string"))


def in_range(value: Column, low: int | None, high: int | None) -> Column:
    """Unknown amounts pass; bounds are inclusive and optional."""
    tests = ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])
    return value.isNull() | reduce(Column.__and__, tests, F.lit(True)) if tests else F.lit(True)


def range_flag(value: Column, flag: Column, low: int | None, high: int | None) -> Column:
    """1 outside the range, 0 inside; unknown amounts and absent bounds leave the flag as it was."""
    if low is None and high is None:
        return flag
    return F.when(value.isNull(), flag).otherwise(F.when(in_range(value, low, high), 0).otherwise(1))


def band_centre(low: int | None, high: int | None) -> float | None:
    """The geometric mean of positive bounds, or the one that is positive."""
    bounds = [b for b in (low, high) if b and b > 0]
    return (bounds[0] * bounds[-1]) ** 0.5 if bounds else None


def band_distance(value: Column, centre: float | None) -> Column:
    if centre is None:
        return F.lit(None).cast("double")
    return F.when(value > 0, F.abs(F.ln(value.cast("double")) - F.ln(F.lit(float(centre)))))


# fixed values: what a usable year needs, in order; those that must be positive, and not zero
RATIO_INPUTS = [
    "current_assets", "total_assets", "current_liab", "noncurrent_liab", "total_liab", "total_equity",
    "revenue", "gross_profit", "operating_income", "net_income",
]
POSITIVE_INPUTS = ["revenue", "total_assets", "current_liab"]
NONZERO_INPUTS = ["total_equity"]


def missing_ratio_inputs(columns: dict[str, Column]) -> Column:
    """Names of inputs that make a year unusable: null, or not positive where that is needed."""
    bad = []
    for k in RATIO_INPUTS:
        v = columns[k]
        wrong = v.isNull()
        if k in POSITIVE_INPUTS:
            wrong = wrong | (v <= 0)
        if k in NONZERO_INPUTS:
            wrong = wrong | (v == 0)
        bad.append(F.when(wrong, F.lit(k)))
    return F.array_compact(F.array(*bad))


def report_ratios(revenue: Column, gross_profit: Column, operating_income: Column, assets: Column, liabilities: Column, equity: Column) -> Column:
    """Struct of gross margin, operating margin, debt ratio and equity ratio; null where it can't be told."""
    usable = revenue.isNotNull() & gross_profit.isNotNull() & operating_income.isNotNull() & assets.isNotNull() & liabilities.isNotNull() & equity.isNotNull()
    usable = usable & (revenue > 0) & (assets > 0) & (equity != 0)
    return F.when(
        usable,
        F.struct(
            F.try_divide(gross_profit, revenue).alias("gross_margin"),
            F.try_divide(operating_income, revenue).alias("operating_margin"),
            F.try_divide(liabilities, equity).alias("debt_ratio"),
            F.try_divide(equity, assets).alias("equity_ratio"),
        ),
    )


def is_extreme(ratios: Column) -> Column:
    return (F.abs(ratios["gross_margin"]) > 1) | (F.abs(ratios["operating_margin"]) > 1)


def hundred_million(value: Column) -> Column:
    return F.round(value.cast("double") * 1e8).cast("bigint")
