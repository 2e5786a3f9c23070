"""Functions of probability theory that Spark lacks, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import clamp_prob

#: The error function after Abramowitz and Stegun, formula 7.1.26.
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function; its error is below 1e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + AS_P * z)
    poly = F.lit(0.0)
    for a in reversed(AS_A):
        poly = (poly + a) * t
    tail = poly * F.exp(-z * z) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def log_odds(p: Column) -> Column:
    p = clamp_prob(p)
    return F.log(p / (1 - p))


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def gbm_above(spot: Column, strike: Column, vol: Column, years: Column) -> Column:
    """P(S_T > K) of a driftless geometric Brownian motion; an indicator where time or volatility is none."""
    sd = vol * F.sqrt(years)
    d = F.try_divide(F.log(spot / strike) - vol * vol * years / 2, sd)
    return F.when((years <= 0) | (vol <= 0), (spot > strike).cast("double")).otherwise(normal_cdf(d))


def with_gbm_touch(df: DataFrame, name: str, spot: Column, barrier: Column, vol: Column, years: Column) -> DataFrame:
    """Adds P(the path reaches the barrier before T), from either side, by the reflection principle.

    The arguments of the distribution function are columns of their own, which keeps the generated
    code within a method's limit.
    """
    sd, b, mu = vol * F.sqrt(years), F.log(barrier / spot), -vol * vol / 2
    sign = F.when(barrier >= spot, 1.0).otherwise(-1.0)
    out = df.withColumns({"__z1": F.try_divide(sign * (mu * years - b), sd), "__z2": F.try_divide(sign * (-b - mu * years), sd), "__e": F.exp(F.try_divide(2 * mu * b, vol * vol)), "__same": barrier == spot, "__none": (years <= 0) | (vol <= 0)})
    out = out.withColumns({"__p1": normal_cdf(F.col("__z1")), "__p2": normal_cdf(F.col("__z2"))})
    reached = F.least(F.greatest(F.col("__p1") + F.col("__e") * F.col("__p2"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn(name, F.when(F.col("__same"), 1.0).when(F.col("__none"), 0.0).otherwise(reached)).drop("__z1", "__z2", "__e", "__same", "__none", "__p1", "__p2")


def normal_cdf_sql(x: str) -> str:
    """The same function as :func:`normal_cdf`, in SQL."""
    z = f"(abs({x}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {AS_P}::DOUBLE * {z}))"
    poly = "0.0::DOUBLE"
    for a in reversed(AS_A):
        poly = f"(({poly} + ({a}::DOUBLE)) * {t})"
    tail = f"({poly} * exp(-{z} * {z}) / 2)"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"
