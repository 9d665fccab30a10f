"""Small dimensions: provinces and their spellings; regions and industries from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def provinces(spark: SparkSession) -> DataFrame:
    rows = [(name, s) for name, spellings in fixed.PROVINCES.items() for s in spellings]
    return spark.createDataFrame(rows, "sido string, spelling string")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """(sido, sigungu) of a JSON object {province: [districts]}; a province without districts has one row with null."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("sido", "d")).select("sido", F.explode_outer("d").alias("sigungu"))


def industries(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, level, parent, position) of a tree of JSON nodes {code, name, children}, three levels deep."""
    kind = "array<struct<code:string,name:string,children:array<struct<code:string,name:string,children:array<struct<code:string,name:string>>>>>>"
    top = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("i", "n"))
    one = top.select(F.col("n.code").alias("code"), F.col("n.name").alias("name"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"), F.col("i").alias("position"))
    mid = top.select("n.code", F.posexplode("n.children").alias("j", "m"))
    two = mid.select(F.col("m.code").alias("code"), F.col("m.name").alias("name"), F.lit(2).alias("level"), F.col("code").alias("parent"), F.col("j").alias("position"))
    low = mid.select(F.col("m.code").alias("up"), F.posexplode("m.children").alias("k", "l"))
    three = low.select(F.col("l.code").alias("code"), F.col("l.name").alias("name"), F.lit(3).alias("level"), F.col("up").alias("parent"), F.col("k").alias("position"))
    return one.unionByName(two).unionByName(three)


def children_of_letters(tree: DataFrame) -> dict[str, list[str]]:
    """Letters of the top level with their divisions; some tens of rows."""
    rows = tree.where("level = 2").orderBy("parent", "position").select("parent", "code").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["parent"], []).append(r["code"])
    return out
