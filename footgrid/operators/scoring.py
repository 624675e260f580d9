"""Safety scores of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footgrid import params
from footgrid.functions.scalar import clip, sigmoid
from footgrid.operators.stats import exact_quantiles
from footgrid.storage import stored


def ml_score(probabilities: dict[str, Column], weights: dict[str, float] = params.ML_WEIGHTS) -> Column:
    """Weighted mean of class weights by probability, nulls as 0, within 0..100."""
    used = [(p, weights[k]) for k, p in probabilities.items() if k in weights]
    if not used:
        raise ValueError("no probability column")
    clean = [F.coalesce(p, F.lit(0.0)) for p, _ in used]
    total = sum(clean[1:], clean[0])
    score = sum((c * w for c, (_, w) in zip(clean[1:], used[1:])), clean[0] * used[0][1])
    return clip(score / F.when(total == 0, 1.0).otherwise(total), 0, 100)


def normalisers(df: DataFrame) -> DataFrame:
    """One row of whole-table statistics for the length and degree terms."""
    stats = [F.min("length_m").alias("len_min"), F.max("length_m").alias("len_max")]
    for c in ("deg_u", "deg_v"):
        if c in df.columns:
            stats.append(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}_q"))
    return df.agg(*stats)


def rule_risk(df: DataFrame) -> DataFrame:
    """Adds risk_raw, safety_sigmoid and safety_robust; missing feature columns count as 0.

    The features are written once, for three passes: whole-table statistics, the
    risk's percentiles (by ranks, no task sees all values) and the scores.
    """
    df = stored(df, "risk")
    df = df.crossJoin(F.broadcast(normalisers(df)))  # one row
    span = F.col("len_max") - F.col("len_min")
    df = df.withColumn("len_norm", F.when(span > 0, (F.col("length_m") - F.col("len_min")) / span).otherwise(0.0))
    for c in ("deg_u", "deg_v"):
        if f"{c}_q" in df.columns:
            q = F.col(f"{c}_q")
            iqr = F.when(q[2] - q[0] == 0, 1.0).otherwise(q[2] - q[0])
            df = df.withColumn(f"{c}_norm", F.coalesce((F.col(c) - q[1]) / iqr, F.lit(0.0))).drop(f"{c}_q")
        else:
            df = df.withColumn(f"{c}_norm", F.lit(0.0))

    def value(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)

    base = sum((value(k) * w for k, w in params.RISK_WEIGHTS.items()), F.lit(0.0))
    gated = sum((value(k) * w for k, w in params.GATE_WEIGHTS.items()), F.lit(0.0))
    flags = [c for c in df.columns if c.startswith("crossing")]
    gate = F.lit(False)
    for c in flags:
        gate = gate | (value(c) > 0)
    if "footway" in df.columns:
        gate = gate | (F.lower(F.coalesce("footway", F.lit(""))) == "crossing")
    risk = (base + F.when(gate, gated).otherwise(0.0)) * (1 + 0.5 * F.col("len_norm")) * (1 + 0.4 * (F.col("deg_u_norm") + F.col("deg_v_norm")))
    df = df.withColumn("risk_raw", F.pow(F.greatest(risk, F.lit(0.0)), F.lit(params.RISK_EXPONENT)))
    low, high = exact_quantiles(df, "risk_raw", (0.01, 0.99))
    if low is None:  # no segments
        low = high = 0.0
    return (
        df.withColumn("safety_sigmoid", 100 * (1 - sigmoid((F.col("risk_raw") - params.SIGMOID_SHIFT) * params.SIGMOID_SCALE)))
        .withColumn("safety_robust", 100 * (1 - (F.least(F.greatest("risk_raw", F.lit(low)), F.lit(high)) - low) / (high - low + 1e-9)))
        .drop("len_min", "len_max")
    )
