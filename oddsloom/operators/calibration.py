"""Calibration maps, and the gate that a map has to pass before it is adopted.

The isotonic fit is mergeable: ranges of forecasts are fitted on their own, and the pooled blocks of neighbours, edge,
total and weight, are pooled again in a tree.  Newton's fit of a group takes its distinct forecasts in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import with_position

MIN_SAMPLES, TRAIN_FRACTION, SPURIOUS = 150, 0.7, 0.08
EPS = 1e-6


def pool(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: right edges and means of the blocks, for rows sorted by x."""
    return pool_weighed(x, y, w)[:2]


def pool_weighed(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`pool`, with the weights of the blocks."""
    top: list[tuple[float, float, float]] = []
    for edge, total, weight in zip(x, y * w, w, strict=True):
        while top and top[-1][1] * weight >= total * top[-1][2]:
            _, t, m = top.pop()
            total, weight = total + t, weight + m
        top.append((edge, total, weight))
    edges, totals, weights = map(np.array, zip(*top, strict=True)) if top else (np.zeros(0),) * 3
    return edges, totals / np.maximum(weights, 1e-300), weights


#: Ranges of forecasts that are fitted on their own, and neighbours that are put together in a round.
RANGES, FANOUT = 64, 8


def isotonic(df: DataFrame, keys: Sequence[str], p: str, y: str, ranges: int = RANGES) -> DataFrame:
    """Knots (x, fitted) of the isotonic fit of each group, from its distinct forecasts.

    Blocks that a range pools are pooled in the whole as well, so each round sends on blocks instead of points; the
    last one of a group has no more rows than its fit has knots and its neighbours had.
    """
    x = F.col(p).cast("double")
    points = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x.alias("x")).agg(F.avg(F.col(y).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        edges, means, weights = pool_weighed(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["w"].to_numpy())
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(edges) for k in keys}, "part": rows["part"].iloc[0], "x": edges, "y": means, "w": weights})

    part = F.floor(F.least(F.greatest(F.col("x"), F.lit(0.0)), F.lit(1.0)) * ranges).cast("long")
    blocks, left = points.withColumn("part", part), ranges + 1
    while True:
        blocks = blocks.groupBy(*keys, "part").applyInPandas(fit, f"{kinds}, part long, x double, y double, w double")
        if left <= 1:
            return blocks.select(*keys, "x", F.col("y").alias("fitted"))
        left = -(-left // FANOUT)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / FANOUT).cast("long"))


def apply_isotonic(x: Sequence[float], fitted: Sequence[float], p: float) -> float:
    """Linear between the knots and flat beyond them; the identity without knots."""
    return float(np.interp(p, x, fitted)) if len(x) else p


def with_knots(df: DataFrame, knots: DataFrame, keys: Sequence[str], p: str, name: str) -> DataFrame:
    """Adds a map's value at ``p``: linear between its knots (x, fitted), flat beyond them, ``p`` itself where a group has none.

    A group's knots are distinct forecasts, so there are no more of them than forecasts have values.
    """
    arrays = knots.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "fitted"))).alias("__k"))
    v = F.col(p).cast("double")
    rows = df.join(arrays, list(keys), "left").withColumn("__below", F.filter("__k", lambda k: k["x"] <= v)).withColumn("__above", F.get(F.filter("__k", lambda k: k["x"] >= v), F.lit(0)))
    rows = rows.withColumn("__below", F.get("__below", F.size("__below") - 1))
    a, b = F.col("__below"), F.col("__above")
    between = a["fitted"] + (b["fitted"] - a["fitted"]) * (v - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    value = F.when(F.col("__k").isNull(), v).when(a.isNull(), b["fitted"]).when(b.isNull() | (a["x"] == b["x"]), a["fitted"]).otherwise(between)
    return rows.withColumn(name, value).drop("__k", "__below", "__above")


def newton(p: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> np.ndarray | None:
    """Logistic weights on (ln p, -ln(1 - p), 1), or None where Newton's rounds do not converge."""
    q = np.clip(p, EPS, 1 - EPS)
    x = np.stack([np.log(q), -np.log(1 - q), np.ones_like(q)], 1)
    beta = np.zeros(3)
    if w.sum() < 3:
        return None
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        curve = np.maximum(mu * (1 - mu), 1e-9) * w
        hessian = x.T @ (x * curve[:, None])
        if abs(np.linalg.det(hessian)) < 1e-12:
            return None
        step = np.linalg.solve(hessian, x.T @ (w * (y - mu)))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            return beta if np.isfinite(beta).all() else None
    return None


def beta_fit(df: DataFrame, keys: Sequence[str], p: str, y: str) -> DataFrame:
    """a, b and c of the beta calibration of each group; null where it declines to fit."""
    points = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(p).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").cast("double").alias("w"))
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        found = newton(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["w"].to_numpy())
        a, b, c = (None, None, None) if found is None else map(float, found)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "a": [a], "b": [b], "c": [c]}).astype({"a": "float64", "b": "float64", "c": "float64"})

    return points.groupBy(*keys).applyInPandas(fit, f"{kinds}, a double, b double, c double")


def threshold(n_validation: Column) -> Column:
    """The improvement that a map must exceed; it falls with the size of the validation fold."""
    return F.when(n_validation > 0, SPURIOUS / F.sqrt(n_validation))


def folds(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds the chronological fold: train for the first 70 percent of a group, else validate."""
    rows = with_position(df, keys, order, "__i", "__n")
    return rows.withColumn("fold", F.when(F.col("__i") <= F.floor(F.col("__n") * TRAIN_FRACTION), "train").otherwise("validate")).drop("__i", "__n")


def adopted(n: Column, brier_identity: Column, brier_fitted: Column, n_validation: Column) -> Column:
    """Whether a map is applied: enough samples, and better than the identity by more than noise."""
    return (n >= MIN_SAMPLES) & F.coalesce(brier_identity - brier_fitted >= threshold(n_validation), F.lit(False))
