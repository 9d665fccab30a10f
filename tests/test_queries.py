"""Every query with SQL against DuckDB on the smallest driver tables."""

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import queries as plans

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(str(plain(v)) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(plans.SQL[name]).df())


def test_filters_reach_the_scan(spark):
    from ledgerloom.operators import predicates
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SF}/customer.parquet").where(predicates.in_industry(F.col("c_mktsegment"), ["BU", "MA"])).select("c_custkey")
    plan = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith" in plan and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
