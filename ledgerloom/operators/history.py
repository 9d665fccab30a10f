"""Yearly histories: which filing a year comes from, and where the auditor changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import auditor_key


def history_fold(filings: DataFrame, years: int, existing: DataFrame | None = None) -> DataFrame:
    """(result_id, fiscal_year, rcept_no, own): the filing that each year of a company is taken from.

    Filings (result_id, rcept_no, fiscal_year) are read newest first. A filing is the own
    source of its year and lends the year before it until that year's own filing is read;
    reading stops when ``years`` years are there and all are own, or when they are there and
    the filing's year is another one. ``existing`` (result_id, fiscal_year, own) is where the
    reading starts from; a company whose years are complete isn't read again.

    A company has some tens of filings; they are folded in one array by SQL functions.
    """
    read = filings.where("coalesce(rcept_no, '') <> '' and fiscal_year is not null").select("result_id", "rcept_no", F.col("fiscal_year").cast("int").alias("fy"))
    rows = read.groupBy("result_id").agg(F.sort_array(F.collect_list(F.struct("rcept_no", "fy")), asc=False).alias("filings"))
    start = F.array().cast("array<struct<fy:int,rcept_no:string,own:boolean,old:boolean>>")
    if existing is not None:
        had = existing.groupBy("result_id").agg(
            F.collect_list(F.struct(F.col("fiscal_year").cast("int").alias("fy"), F.lit(None).cast("string").alias("rcept_no"), F.col("own").cast("boolean").alias("own"), F.lit(True).alias("old"))).alias("had")
        )
        rows = rows.join(had, "result_id", "left")
        start = F.coalesce("had", start)
    else:
        rows = rows.withColumn("had", start)
    state = F.struct(start.alias("got"), F.lit(False).alias("done"))

    def has(got: Column, year: Column, own_only: bool = False) -> Column:
        return F.exists(got, lambda g: (g["fy"] == year) & (g["own"] if own_only else F.lit(True)))

    def entry(year: Column, filing: Column, own: bool) -> Column:
        return F.struct(year.cast("int").alias("fy"), filing["rcept_no"].alias("rcept_no"), F.lit(own).alias("own"), F.lit(False).alias("old"))

    def step(s: Column, filing: Column) -> Column:
        got, year = s["got"], filing["fy"]
        full = F.size(got) >= years
        done = s["done"] | (full & F.forall(got, lambda g: g["own"])) | (full & ~has(got, year))
        take = ~has(got, year, own_only=True) & (has(got, year) | ~full)
        with_own = F.when(take, F.concat(F.filter(got, lambda g: g["fy"] != year), F.array(entry(year, filing, True)))).otherwise(got)
        lend = ~has(with_own, year - 1) & (F.size(with_own) < years)
        with_prior = F.when(lend, F.concat(with_own, F.array(entry(year - 1, filing, False)))).otherwise(with_own)
        return F.struct(F.when(done, got).otherwise(with_prior).alias("got"), done.alias("done"))

    first = F.array_min(F.transform(F.col("had"), lambda g: g["fy"]))
    complete = (F.size("had") >= years) & F.forall("had", lambda g: g["own"] | (g["fy"] == first))
    folded = rows.where(~F.coalesce(complete, F.lit(False))).select("result_id", F.aggregate("filings", state, step)["got"].alias("got"))
    out = folded.select("result_id", F.explode("got").alias("g")).where("not g.old")
    return out.select("result_id", F.col("g.fy").cast("string").alias("fiscal_year"), F.col("g.rcept_no").alias("rcept_no"), F.col("g.own").cast("int").alias("from_current_period"))


def with_auditor_change(history: DataFrame, keys: list[str], year: str = "fiscal_year", name: str = "auditor_name") -> DataFrame:
    """Add ``changed_from_prev``: whether the auditor differs from the last known one; null if either is unknown."""
    before = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    rows = history.withColumn("_key", auditor_key(F.col(name)))
    return rows.withColumn("changed_from_prev", F.col("_key") != F.last("_key", ignorenulls=True).over(before)).drop("_key")


def company_auditor_change(history: DataFrame, keys: list[str], name: str = "auditor_name") -> DataFrame:
    """1 if two auditors are known, 0 if one is known by two names or more, else null."""
    key = auditor_key(F.col(name))
    counted = history.groupBy(*keys).agg(F.countDistinct(key).alias("_keys"), F.count(name).alias("_names"))
    return counted.select(*keys, F.when(F.col("_keys") >= 2, 1).when((F.col("_keys") == 1) & (F.col("_names") >= 2), 0).alias("auditor_changed"))


def newest_labels(accounts: DataFrame) -> DataFrame:
    """Per (item, key) the label and level of the newest year."""
    return accounts.groupBy("item", "key").agg(F.max_by(F.struct("label", "level"), "fiscal_year").alias("n")).select("item", "key", "n.label", "n.level")


def history_cells(accounts: DataFrame, columns: DataFrame) -> DataFrame:
    """Amounts by (item, key) and column year: current amounts of a filing of that year, prior ones of the next.

    ``columns`` (column_year, rcept_no) tells which filing a column comes from.
    """
    cells = columns.join(accounts, "rcept_no")
    own = F.col("fiscal_year") == F.col("column_year")
    return cells.groupBy("item", "key", "column_year").agg(F.max(F.when(own, F.col("cur")).otherwise(F.col("prv"))).alias("amount"))
