"""Peers of a company: usable years, comparison pools, nearest companies and averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.amounts import RATIO_INPUTS, is_extreme, missing_ratio_inputs, report_ratios
from ..functions.text import is_unreliable_opinion, stripped
from .ordering import materialised, ranked

MAX_PEERS = 8
MAX_REGION = 15
MIN_SAMPLE = 2
PREFIXES = [3, 2]
#: places of the global order of amounts that one task looks at
BLOCK = 10_000


def year_order(year: Column) -> list[Column]:
    """Numeric years first, other texts after them."""
    number = year.try_cast("int")
    return [number.isNull().asc(), number.asc(), year.asc()]


def usable_years(snapshots: DataFrame) -> DataFrame:
    """Years that reports can use, with marks for partial and borrowed ones."""
    missing = missing_ratio_inputs({k: F.col(k) for k in RATIO_INPUTS})
    status = F.upper(F.trim(F.coalesce("parse_status", F.lit(""))))
    rows = snapshots.where(status != "FAILED").withColumn("missing", missing).where(F.size("missing") == 0).drop("missing")
    return rows.withColumn("is_partial", status == "PARTIAL").withColumn("is_borrowed", F.coalesce(F.col("from_current_period") != 1, F.lit(True)))


def excluded_years(snapshots: DataFrame) -> DataFrame:
    """Per result the failed years, then the incomplete ones."""
    missing = missing_ratio_inputs({k: F.col(k) for k in RATIO_INPUTS})
    failed = F.upper(F.trim(F.coalesce("parse_status", F.lit("")))) == "FAILED"
    years = snapshots.select("result_id", "fiscal_year", failed.alias("failed"), ((F.size(missing) > 0) & ~failed).alias("incomplete"))

    def listed(c):
        return F.array_sort(F.array_compact(F.collect_list(F.when(F.col(c), F.col("fiscal_year")))))

    return years.groupBy("result_id").agg(F.concat(listed("failed"), listed("incomplete")).alias("excluded_years"))


def peer_pool(results: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per company that can be compared: its latest usable year, without extreme ratios."""
    fresh = results.where("coalesce(excluded_by_stale_disclosure, 0) <> 1")
    number = F.col("fiscal_year").try_cast("int")
    latest = usable_years(snapshots).groupBy("result_id").agg(
        F.max_by(
            F.struct("fiscal_year", "revenue", "gross_profit", "operating_income", "total_assets", "total_liab", "total_equity", "is_partial"),
            F.struct(number.isNull(), number, F.col("fiscal_year")),
        ).alias("y")
    )
    ratios = report_ratios(*[F.col(f"y.{c}") for c in ("revenue", "gross_profit", "operating_income", "total_assets", "total_liab", "total_equity")])
    pool = fresh.select(F.col("id").alias("result_id"), "corp_name", stripped(F.coalesce("induty_code", F.lit(""))).alias("induty_code"), "induty_name", "audit_opinion").join(latest, "result_id")
    pool = pool.select("result_id", "corp_name", "induty_code", "induty_name", "audit_opinion", F.col("y.fiscal_year").alias("year"), F.col("y.revenue").alias("revenue"), F.col("y.gross_profit").alias("gross_profit"), F.col("y.is_partial").alias("is_partial"), ratios.alias("ratios"))
    return pool.where(F.col("ratios").isNotNull() & ~is_extreme(F.col("ratios")))


def nearest(targets: DataFrame, pool: DataFrame, limit: int, code: str = "induty_code", amount: str = "revenue", key: str = "result_id") -> DataFrame:
    """For each target the ``limit`` companies of its industry that are nearest by amount, ties by id.

    The longer common prefix counts if two or more other companies have it, else the shorter
    one. No pairs of an industry are formed: the nearest of a target stand within ``limit``
    distinct amounts on either side of its own, and of each amount only the ``limit`` + 1
    smallest ids can be among them. The amounts of all industries and both prefixes stand in
    one global order, which is cut into blocks of ``BLOCK`` places, each with the ``limit``
    places beside it; so an industry with very many companies is spread over tasks.
    Both tables are used several times: pass written ones.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.substring(code, 1, n).alias("prefix")) for n in PREFIXES])).alias("l")
    group = ["level", "prefix"]

    def by_level(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col(key).alias(name), F.col(amount).alias("at"), levels).select(name, "at", "l.*").where(F.length("prefix") == F.col("level"))

    mine, theirs = by_level(targets, "target_id"), by_level(pool, "peer_id")
    first = Window.partitionBy(*group, "at").orderBy("peer_id")
    few = theirs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit + 1)
    amounts = few.groupBy(*group, "at").agg(F.collect_list("peer_id").alias("ids"))
    amounts = mine.select(*group, "at").distinct().join(amounts, [*group, "at"], "full")
    # amounts of targets that nobody in the pool has stand between the others and are not counted
    placed = ranked(amounts, [*group, "at"], counted=F.col("ids").isNotNull())
    block = lambda c: F.floor(c / BLOCK)
    copies = F.when(F.col("ids").isNull(), F.array(block(F.col("place")))).otherwise(F.sequence(block(F.col("place") - limit), block(F.col("place") + limit)))
    placed = placed.withColumn("block", F.explode(copies))
    around = Window.partitionBy("block").orderBy("place").rangeBetween(-limit, limit)
    side = F.struct(*group, F.col("at").alias("amount"), "ids")
    placed = placed.withColumn("near", F.collect_list(F.when(F.col("ids").isNotNull(), side)).over(around)).where(F.col("block") == block(F.col("place")))
    placed = placed.select(*group, "at", F.filter("near", lambda v: (v["level"] == F.col("level")) & (v["prefix"] == F.col("prefix"))).alias("near"))
    pairs = mine.join(placed, [*group, "at"]).select("target_id", "level", "at", F.explode("near").alias("v"))
    pairs = pairs.select("target_id", "level", F.abs(F.col("v.amount") - F.col("at")).alias("distance"), F.explode("v.ids").alias("peer_id")).where("target_id <> peer_id")
    by = Window.partitionBy("target_id", "level").orderBy("distance", "peer_id")
    found = pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    # the longest prefix that enough other companies have
    sizes = theirs.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    own = pool.select(F.col(key).alias("target_id"), F.lit(1).alias("self"))
    others = mine.join(sizes, group).join(own, "target_id", "left").select("target_id", "level", (F.col("n") - F.coalesce("self", F.lit(0))).alias("n"))
    level = others.where(F.col("n") >= MIN_SAMPLE).groupBy("target_id").agg(F.max("level").alias("level"))
    return found.join(level, ["target_id", "level"]).select("target_id", "peer_id", "level", "rank", "distance")


def select_peers(targets: DataFrame, pool: DataFrame, limit: int = MAX_PEERS) -> DataFrame:
    """Nearest companies of the industry whose opinions can be relied on."""
    return nearest(targets, pool.where(~is_unreliable_opinion(F.col("audit_opinion"))), limit)


def region_group(targets: DataFrame, pool: DataFrame, limit: int = MAX_REGION) -> DataFrame:
    """The target, then its neighbours; amounts under unreliable opinions are hidden, never the target's."""
    near = materialised(nearest(targets, pool, limit).select("target_id", F.col("peer_id").alias("result_id"), "rank"))
    own = near.select("target_id").distinct().select("target_id", F.col("target_id").alias("result_id"), F.lit(0).alias("rank"))
    rows = own.unionByName(near).join(pool, "result_id")
    is_target = F.col("rank") == 0
    hidden = ~is_target & is_unreliable_opinion(F.col("audit_opinion"))
    opinion = F.coalesce(F.nullif(F.trim(F.coalesce("audit_opinion", F.lit(""))), F.lit("")), F.lit(fixed.UNKNOWN_OPINION))
    return rows.select(
        "target_id", "rank", F.col("corp_name").alias("name"), F.col("induty_name").alias("industry"),
        F.when(~hidden, F.col("revenue")).alias("revenue"), F.when(~hidden, F.col("ratios.gross_margin")).alias("gross_margin"),
        opinion.alias("opinion"), is_target.alias("is_target"),
    )


def industry_average(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Per target the gross margin of its peers, weighted by revenue; the target itself doesn't count."""
    rows = pairs.join(pool.select(F.col("result_id").alias("peer_id"), "revenue", "gross_profit"), "peer_id")
    return rows.groupBy("target_id").agg(F.try_divide(F.sum("gross_profit"), F.nullif(F.sum("revenue"), F.lit(0))).alias("gross_margin"), F.count(F.lit(1)).alias("n_peers"))


def year_note(years: Column, target_year: Column) -> Column:
    """Which years a comparison covers; ``years`` is the array of the peers' years."""
    labels = F.array_sort(F.array_distinct(F.filter(years, lambda y: y.isNotNull() & (y != ""))))
    first, last = F.get(labels, F.lit(0)), F.get(labels, F.size(labels) - 1)
    span = F.when(first == last, first).otherwise(F.concat(first, F.lit("~"), last))
    target = F.coalesce(target_year, F.lit(""))
    return (
        F.when(F.size(labels) == 0, F.lit("각 사 최근 결산연도 기준"))
        .when((target != "") & (F.size(labels) == 1) & (first == target), F.concat(target, F.lit("년 기준")))
        .when(target == "", F.concat(F.lit("비교사 최근 결산연도 "), span, F.lit("년 기준")))
        .otherwise(F.concat(F.lit("각 사 최근 결산연도 기준 · 대상 "), target, F.lit("년 / 비교사 "), span, F.lit("년")))
    )


def peer_rows(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Per target the array of its peers in rank order; at most ``MAX_PEERS`` of them."""
    rows = pairs.join(pool.withColumnRenamed("result_id", "peer_id"), "peer_id")
    item = F.struct("rank", F.col("corp_name").alias("name"), "revenue", F.col("ratios.gross_margin").alias("gross_margin"), F.col("ratios.operating_margin").alias("operating_margin"), F.col("ratios.debt_ratio").alias("debt_ratio"), F.col("ratios.equity_ratio").alias("equity_ratio"))
    return rows.groupBy("target_id").agg(F.array_sort(F.collect_list(item)).alias("peers"), F.collect_set("year").alias("peer_years"))


def report_payload(results: DataFrame, snapshots: DataFrame, pool: DataFrame) -> DataFrame:
    """(result_id, payload): the JSON of a company's report, for companies with a usable year."""
    pool = materialised(pool)
    years = usable_years(snapshots)
    row = F.struct(F.col("fiscal_year").alias("year"), *[F.col(c) for c in RATIO_INPUTS])
    financials = years.groupBy("result_id").agg(F.array_sort(F.collect_list(row)).alias("financials"))
    pairs = materialised(select_peers(pool, pool))
    peers = peer_rows(pairs, pool).join(industry_average(pairs, pool), "target_id").withColumnRenamed("target_id", "result_id")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    company = F.struct(*[blank(c) for c in ("corp_name", "address", "ceo_name", "induty_name", "auditor_name", "audit_opinion")])
    rows = results.select(F.col("id").alias("result_id"), company.alias("company")).join(financials, "result_id").join(peers, "result_id", "left")
    return rows.select("result_id", F.to_json(F.struct("company", "financials", "peers", F.col("gross_margin").alias("industry_average"))).alias("payload"))


def warnings(snapshots: DataFrame) -> DataFrame:
    """Per result the kinds of warnings that its years give."""
    failed = F.upper(F.trim(F.coalesce("parse_status", F.lit("")))) == "FAILED"
    missing = F.size(missing_ratio_inputs({k: F.col(k) for k in RATIO_INPUTS})) > 0
    flags = snapshots.groupBy("result_id").agg(
        F.count_if(~failed & ~missing).alias("usable"), F.count_if(failed).alias("failed"), F.count_if(~failed & missing).alias("incomplete"),
        F.count_if(F.col("parse_status") == "PARTIAL").alias("partial"), F.count_if(F.col("from_current_period") == 0).alias("borrowed"), F.count_if(F.col("total_equity") < 0).alias("negative_equity"),
    )
    kinds = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in ("failed", "incomplete", "partial", "borrowed", "negative_equity")]))
    return flags.select("result_id", F.when(F.col("usable") == 0, F.array(F.lit("nothing_usable"))).otherwise(kinds).alias("warnings"))


def comparison_warnings(chosen: DataFrame, shown: int = fixed.WARNING_NAMES) -> DataFrame:
    """(target_id, n, names, text): the compared companies whose year is only partly read, each once, in the order of ``rank``.

    ``chosen`` has target_id, result_id, name, year, partial and rank. A target's companies are
    first reduced to one row each, so what is put in order is as many as a comparison shows.
    """
    first = chosen.where("partial").groupBy("target_id", "result_id").agg(F.min(F.struct("rank", "name", "year")).alias("c"))
    label = F.concat(F.coalesce("c.name", F.lit("")), F.lit("("), F.col("c.year"), F.lit(f"{fixed.YEAR_SUFFIX})"))
    found = first.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct(F.col("c.rank").alias("rank"), "result_id", label.alias("label")))).alias("all"))
    names = F.transform("all", lambda x: x["label"])
    rest = F.size("all") - shown
    text = F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(rest > 0, F.concat(F.lit(fixed.MORE_NAMES[0]), rest.cast("string"), F.lit(fixed.MORE_NAMES[1]))).otherwise(""))
    return found.select("target_id", F.size("all").cast("bigint").alias("n"), F.slice(names, 1, shown).alias("names"), text.alias("text"))


def is_placeholder(contact: Column) -> Column:
    """Whether a contact is blank or still the text that asks for one."""
    text = stripped(F.coalesce(contact, F.lit("")))
    return (text == "") | text.startswith(fixed.CONTACT_PLACEHOLDER)
