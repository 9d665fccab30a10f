"""Order of candidates by how near their reference figures are to the wished ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import band_centre, band_distance
from .ordering import ranked, ranked_within


def with_band_score(df: DataFrame, revenue: dict | None, assets: dict | None, revenue_col: str = "ref_revenue", assets_col: str = "ref_total_assets") -> DataFrame:
    """Add ``score``: the mean of the known log distances, the median of all for rows without any.

    The median is exact: the distinct distances with their numbers of rows are placed in one
    distributed order, so that no task holds them all.
    """
    pairs = [(revenue_col, revenue), (assets_col, assets)]
    distances = [band_distance(F.col(c), band_centre((b or {}).get("min_krw"), (b or {}).get("max_krw"))) for c, b in pairs]
    known = F.array_compact(F.array(*distances))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    scored = df.withColumn("_known", mean)
    return scored.withColumn("score", F.coalesce("_known", F.lit(median(scored, "_known") or 0.0))).drop("_known")


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of a column's known values; of an even number of rows the mean of the middle two."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(values, [column], counted=F.col("n"))  # place: rows up to and with this value
    n = placed.agg(F.max("place")).first()[0]
    if n is None:
        return None
    low, high = placed.agg(*[F.min(F.when(F.col("place") >= k, F.col(column))) for k in ((n + 1) // 2, n // 2 + 1)]).first()
    return (low + high) / 2


def band_rank(df: DataFrame, keys: list[str], **bands) -> DataFrame:
    """Rank by score and id inside each job."""
    return ranked_within(with_band_score(df, **bands), keys, ["score", "id"], "band_rank")
