"""Feature statistics, imputation and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def means(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of column means; null and NaN do not count."""
    return rows.agg(*[F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(f"{c}_mean") for c in features])


def impute(rows: DataFrame, features: Sequence[str], known: DataFrame) -> DataFrame:
    """Missing features replaced by the means given, which are those of training when rows are scored."""
    joined = rows.crossJoin(F.broadcast(known))  # one row
    keep = [c for c in rows.columns if c not in features]
    return joined.select(*keep, *[F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.col(f"{c}_mean")).alias(c) for c in features])


def summary(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, stdDev, low, high, variance) of imputed rows: population variance, in one pass for all features."""
    stats = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("stdDev"), F.min(c).alias("low"), F.max(c).alias("high"), F.var_pop(c).alias("variance")) for c in features]
    return rows.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def zscore(x: Column, mean: Column, std: Column, eps: float = 1e-6) -> Column:
    """(x - mean) / (std + eps), the form of scoring."""
    return (x - mean) / (std + eps)


def zscore_named(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std with 1 for a std of 0, the form of stored normalizers."""
    return (x - mean) / F.when(std == 0, 1.0).otherwise(std)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low + 1e-5)


def dot(columns: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    total = F.lit(float(bias))
    for c, w in zip(columns, weights, strict=True):
        total = total + c * float(w)
    return total


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def softmax_two(a: Column, b: Column) -> Column:
    """Probability of the second of two logits, by their largest."""
    top = F.greatest(a, b)
    return F.exp(b - top) / (F.exp(a - top) + F.exp(b - top))
