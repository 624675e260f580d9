"""Score statistics by method and area."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footgrid.params import LOW_SCORE
from footgrid.schema import numbered


def by_method(scores: DataFrame, **columns: str) -> DataFrame:
    """Wide score columns to rows of (method, score)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.col(c).alias("score")) for k, c in columns.items()]))
    return scores.withColumn("_p", pairs).withColumns({"method": F.col("_p.method"), "score": F.col("_p.score")}).drop("_p")


def summary(rows: DataFrame, *keys: str, low: float = LOW_SCORE) -> DataFrame:
    """count, min, max, mean, median, std, and how many scores are below ``low``; null scores and null keys don't count."""
    kept = rows
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    below = F.count_if(F.col("score") < low)
    return kept.groupBy(*keys).agg(
        F.count("score").alias("n"), *[F.round(f("score"), 6).alias(k) for k, f in (("min_score", F.min), ("max_score", F.max), ("mean_score", F.avg), ("median_score", F.median), ("std_score", F.stddev_samp))],
        below.alias("n_below"), F.round(100.0 * below / F.nullif(F.count("score"), F.lit(0)), 6).alias("pct_below"),
    )


def exact_quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Quantiles of a whole column by linear interpolation, nulls left out: rows are ranked by range, then only the ranks asked for are read."""
    ranked = numbered(df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), "i", (), "v")
    n = ranked.count()
    if not n:
        return [None] * len(shares)
    places = [share * (n - 1) for share in shares]
    asked = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places})
    found = {r["i"]: r["v"] for r in ranked.where(F.col("i").isin(*asked)).collect()}  # two a share
    return [found[int(p)] + (found[min(int(p) + 1, n - 1)] - found[int(p)]) * (p - int(p)) for p in places]
