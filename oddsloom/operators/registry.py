"""Models as transforms: each turns markets into rows of opinion, and the pool takes whatever is registered.

A model is a function ``DataFrame -> DataFrame`` from markets to rows with :data:`OPINION`; its declaration says what it
may count as evidence for.  The pool reads declarations from the registry, so a model is added by registering it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from . import probability as P

#: Columns of an opinion, with their types.
OPINION = {"probability": "double", "confidence": "double", "stdev": "double", "freshness": "long"}


@dataclass(frozen=True)
class Model:
    """A transform with what is declared of it; ``categories`` are those that it is asked about (none: all)."""

    name: str
    source_type: str
    correlation_group: str
    reliability: float
    opine: Callable[[DataFrame], DataFrame]
    categories: tuple[str, ...] = ()

    @property
    def independent(self) -> bool:
        return self.source_type not in P.MARKET_SOURCES


class Models:
    """The models that a pool asks."""

    def __init__(self, models: Iterable[Model] = ()):
        self._of: dict[str, Model] = {}
        for m in models:
            self.register(m)

    def register(self, model: Model) -> Model:
        if model.name in self._of:
            raise ValueError(f"{model.name} is registered already")
        if not 0 <= model.reliability <= 1:
            raise ValueError(f"the reliability of {model.name} is not between 0 and 1")
        self._of[model.name] = model
        return model

    def names(self) -> list[str]:
        return sorted(self._of)

    def declarations(self, spark: SparkSession) -> DataFrame:
        """What the pool needs to know of each component; a row for each model."""
        rows = [(m.name, m.source_type, m.correlation_group, m.reliability, m.independent) for m in self._of.values()]
        return spark.createDataFrame(rows, "component string, source_type string, correlation_group string, reliability double, independent boolean")

    def opinions(self, markets: DataFrame, key: str = "market_id") -> DataFrame:
        """The opinions of all models on ``markets`` (market_id, category and what they read): one union, each part a plan of its own.

        A model that names its categories sees only their markets.  One without an opinion gives no row, or a null probability.
        """
        kind = dict(markets.dtypes)[key]
        parts = []
        for m in self._of.values():
            asked = markets.where(F.col("category").isin(*m.categories)) if m.categories else markets
            said = m.opine(asked)
            missing = {key, "probability", "confidence"} - set(said.columns)
            if missing:
                raise ValueError(f"{m.name} gives no {sorted(missing)}")
            given = [(F.col(c) if c in said.columns else F.lit(None)).cast(t).alias(c) for c, t in OPINION.items()]
            parts.append(said.select(F.col(key).cast(kind).alias(key), F.lit(m.name).alias("component"), *given))
        if not parts:
            return markets.sparkSession.createDataFrame([], f"{key} {kind}, component string, " + ", ".join(f"{c} {t}" for c, t in OPINION.items()))
        return reduce(DataFrame.unionByName, parts)

    def pool(self, markets: DataFrame) -> DataFrame:
        """The pool of the opinions of all models on each market; markets without any have no row."""
        return P.pooled(self.opinions(markets), self.declarations(markets.sparkSession))


@arrow_udtf(returnType="book_id long, side string, requested double, filled double, notional double, worst double, n_levels long")
class WalkLevels:
    """Walks ladders for a list of sizes: ``walk_levels(sizes, TABLE(levels) PARTITION BY (book_id, side) ORDER BY price)``.

    ``levels`` has book_id, side, price and size (doubles), best price first within a partition; sizes are numbers in a
    string, parted by commas.  What crosses batches is the depth so far of each size, so a ladder is never held.  A size of
    which nothing can be had has no row.
    """

    def __init__(self):
        self.key = self.sizes = None

    def eval(self, sizes: pa.Array, levels: pa.RecordBatch) -> Iterable[pa.Table]:
        price, size = levels.column("price").to_numpy(), levels.column("size").to_numpy()
        if not len(price):
            return
        if self.key is None:
            self.key = levels.column("book_id")[0].as_py(), levels.column("side")[0].as_py()
            self.sizes = sorted({float(x) for x in sizes[0].as_py().split(",")})
            self.filled, self.notional, self.worst, self.n = ([0.0] * len(self.sizes) for _ in range(4))
        for i, wanted in enumerate(self.sizes):
            left = wanted - self.filled[i]
            if left <= 0:
                continue
            through = size.cumsum()
            take = (through.clip(max=left) - (through - size).clip(max=left)).clip(min=0)
            used = take > 0
            if used.any():
                self.filled[i] += float(take.sum())
                self.notional[i] += float((take * price).sum())
                self.worst[i] = float(price[used].max())
                self.n[i] += int(used.sum())
        return
        yield

    def terminate(self) -> Iterable[pa.Table]:
        if self.key is None:
            return
        on = [i for i, x in enumerate(self.filled) if x > 0]
        kinds = [pa.int64(), pa.string(), *[pa.float64()] * 4, pa.int64()]
        columns = [[self.key[0]] * len(on), [self.key[1]] * len(on), *([of[i] for i in on] for of in (self.sizes, self.filled, self.notional, self.worst)), [int(self.n[i]) for i in on]]
        names = ["book_id", "side", "requested", "filled", "notional", "worst", "n_levels"]
        yield pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def register_walk(spark: SparkSession, name: str = "walk_levels") -> str:
    """Make the table function known to SQL."""
    spark.udtf.register(name, WalkLevels)
    return name
