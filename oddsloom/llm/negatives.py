"""Hard negatives of anchors by a pivot table over augmented vectors.

Components become integers, so scores are exact.  With M the greatest squared norm, a vector x becomes
(x, sqrt(M - |x|^2)) and an anchor a becomes (a, 0); then |a - x|^2 = |a|^2 + M - 2 a.x, and the largest inner
product is the least Euclidean distance.  The pivot table has the distance of every row to some pivots.  By the triangle
inequality, |d(a, p) - d(x, p)| <= d(a, x) <= d(a, p) + d(x, p) for every pivot p, which brackets a.x; only rows whose
bracket reaches the scores that are still asked for are checked exactly.

Rows lie in cells, by their nearest pivot, which hold the table's least and greatest distances to each pivot.  An anchor
first searches its own cell, which gives a bound, and then the cells whose bracket reaches that bound.  Cells are cut into
shards and anchors into crowds of a bounded number of rows; inside a task, leaves of rows are bracketed before
rows are.  Pivots and cells decide how much is checked, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidied

#: Pivots, and rows of the sample they are picked from, farthest first.
PIVOTS, SAMPLE = 16, 4096
#: Rows of a shard, anchors of a crowd, and rows of a leaf.
SHARD_ROWS, CROWD_ROWS, LEAF = 8192, 4096, 64
#: Anchors that a task brackets at once.
CHUNK = 64
#: Rounding of distances: what a bracket is widened by, as a share of M.
SLACK = 1e-9
#: Beyond this squared norm, inner products may not fit into a long.
MOST_NORM = float(1 << 62)
ROW = "vec_id long, label long, vector binary, width int, norm double"
FOUND = "anchor_id long, other_id long, score long"
BRACKETED = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector (64-bit integers, packed), width and norm (squared) of the rows that take part.

    ``vectors`` has vec_id, embedding and label.  Rows with a null vec_id, label or vector, with a null or non-finite
    component, or with integers whose inner product with themselves does not fit into a long take none.  Of rows with one vec_id
    that with the greatest label, then vector, counts.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", odd))
    one = rows.groupBy("vec_id").agg(F.max(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            lists = batch.column(2)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            whole = np.floor(np.asarray(lists.flatten()) * scale)
            norm = np.array([np.dot(whole[a:b], whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
            fits = norm < MOST_NORM
            packed = [whole[a:b].astype(np.int64).tobytes() if ok else b"" for a, b, ok in zip(at[:-1], at[1:], fits, strict=True)]
            out = [batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(np.diff(at).astype(np.int32)), pa.array(norm)]
            yield pa.record_batch(out, ["vec_id", "label", "vector", "width", "norm"]).filter(pa.array(fits))

    return one.mapInArrow(run, ROW)


def relabelled(step: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one modulo ``labels`` where vec_id is divisible by ``step``."""
    return F.when(F.col("vec_id") % step == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(labels))).otherwise(F.col("label").cast("long"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Packed vectors of one width as rows of integers."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), -1)


class PivotTable:
    """Pivots of one width, and distances to them in augmented space."""

    def __init__(self, sample: np.ndarray, most: float):
        self.most = most
        x = sample.astype(np.float64)
        top = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
        full = np.concatenate([x, top[:, None]], 1)
        picked = [int(np.argmax(top))]
        gap = ((full - full[picked[0]]) ** 2).sum(1)
        while len(picked) < min(PIVOTS, len(full)) and gap.max() > 0:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, ((full - full[picked[-1]]) ** 2).sum(1))
        self.pivots = full[picked]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of rows to the pivots."""
        x = x.astype(np.float64)
        return self._to(np.concatenate([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]], 1))

    def asked(self, a: np.ndarray) -> np.ndarray:
        """Of anchors, whose added component is 0."""
        a = a.astype(np.float64)
        return self._to(np.concatenate([a, np.zeros((len(a), 1))], 1))

    def _to(self, full: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((full - p) ** 2).sum(1)) for p in self.pivots], 1)

    def upper(self, norms: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most that the score of an anchor (rows) can be in each bracket [low, high] of distances (columns), by its widest gap."""
        gap = np.zeros((len(asked), len(low)))
        for p in range(asked.shape[1]):
            at = asked[:, p, None]
            np.maximum(gap, np.maximum(at - high[None, :, p], low[None, :, p] - at), out=gap)
        return (norms[:, None] + self.most - gap * gap) / 2 + (SLACK * (self.most + norms) + 1)[:, None]

    def lower(self, norms: np.ndarray, asked: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least that the score of an anchor can be, by its shortest way over a pivot."""
        reach = np.full((len(asked), len(high)), np.inf)
        for p in range(asked.shape[1]):
            np.minimum(reach, asked[:, p, None] + high[None, :, p], out=reach)
        return (norms[:, None] + self.most - reach * reach) / 2 - (SLACK * (self.most + norms) + 1)[:, None]


def _leaves(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows, starts of its leaves, and the least and greatest distances of each leaf."""
    near = distances.argmin(1)
    order = np.lexsort((distances[np.arange(len(near)), near], near))
    starts = np.arange(0, len(order), LEAF)
    return order, starts, np.minimum.reduceat(distances[order], starts, axis=0), np.maximum.reduceat(distances[order], starts, axis=0)


class Shard:
    """Rows of a shard with their part of the pivot table, in leaves."""

    def __init__(self, rows: pa.Table, pivots: PivotTable, exact: bool):
        x, distances = _matrix(rows.column("vector")), np.frombuffer(b"".join(rows.column("distances").to_pylist()), np.float64).reshape(rows.num_rows, -1)
        order, self.starts, self.low, self.high = _leaves(distances)
        # Doubles are exact where no inner product can exceed 2**53; integers wrap on the way, and come back.
        self.x, self.distances = x[order].astype(np.float64 if exact else np.int64), distances[order]
        self.ids, self.labels = rows.column("vec_id").to_numpy()[order], rows.column("label").to_numpy()[order]
        self.pivots = pivots

    def survivors(self, a: np.ndarray, norms: np.ndarray, asked: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each anchor, rows and scores with least <= score <= most, best first, ties by smaller id.

        Leaves are bracketed, then the rows of those that are left, and what is left of these is scored.
        """
        a = a.astype(self.x.dtype)
        for c in range(0, len(a), CHUNK):
            part = slice(c, c + CHUNK)
            wide = (self.pivots.upper(norms[part], asked[part], self.low, self.high) >= least[part, None]) & (self.pivots.lower(norms[part], asked[part], self.high) <= most[part, None])
            leaves = np.flatnonzero(wide.any(0))
            at = (leaves[:, None] * LEAF + np.arange(LEAF)[None]).reshape(-1)
            at = at[at < len(self.ids)]
            d = self.distances[at]
            on = (self.pivots.upper(norms[part], asked[part], d, d) >= least[part, None]) & np.repeat(wide[:, leaves], LEAF, axis=1)[:, : len(at)]
            score = (self.x[at] @ a[part].T).T.astype(np.int64)
            on &= (score >= least[part, None]) & (score <= most[part, None])
            for i in range(len(score)):
                hit = np.flatnonzero(on[i])
                order = np.lexsort((self.ids[at[hit]], -score[i, hit]))
                yield at[hit[order]], score[i, hit[order]]


def _floor_ratio(score: int, numerator: int, denominator: int) -> int:
    """The least integer s with denominator * s >= numerator * score."""
    return -(-numerator * score // denominator)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label.  A row's score for an anchor is the inner product of their vectors, with
    components floor(``scale`` * x); higher scores come first, ties go to the smaller vec_id.  An anchor's positives are its
    first other rows of the same label; for each, the negatives are the first rows of other labels with
    percent[0] * positive_score <= 100 * negative_score <= percent[1] * positive_score.

    :func:`prepared` says which rows take part.  A row has no score for an anchor whose vector is of another length.  An anchor
    without positives, or a positive without negatives, has no rows.  An empty table, or one without anchors, gives an empty
    result; other columns are ignored.
    """
    rows = stored(prepared(vectors, scale), "negatives-rows")
    spark = vectors.sparkSession
    widths = [r.width for r in rows.select("width").distinct().orderBy("width").limit(WIDTHS + 1).collect()]
    if len(widths) > WIDTHS:
        raise ValueError(f"vectors of more than {WIDTHS} lengths")
    out = None
    for width in widths:
        one = _mined(rows.where(F.col("width") == width), is_anchor, positives, negatives, percent)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


#: Lengths of vectors in a table, at most; more are refused, as they tell of a broken table.
WIDTHS = 64


def _mined(rows: DataFrame, is_anchor: Column, n_positives: int, n_negatives: int, percent: tuple[int, int]) -> DataFrame:
    most = rows.agg(F.max("norm")).first()[0]
    exact = most < float(1 << 52)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    pivots = PivotTable(_matrix(picked.column(0)), most)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            d = pivots.distances(x)
            yield pa.record_batch([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(d.argmin(1).astype(np.int32)), pa.array([r.tobytes() for r in d], pa.binary()), pa.array(list(d))], ["vec_id", "label", "vector", "norm", "cell", "distances", "d"])

    placed = stored(rows.mapInArrow(measure, "vec_id long, label long, vector binary, norm double, cell int, distances binary, d array<double>"), "negatives-pivots")
    # One row for each cell, as there are at most as many cells as pivots.
    n = len(pivots.pivots)
    brackets = placed.groupBy("cell").agg(F.count("*").alias("n"), F.array(*(F.min(F.col("d")[i]) for i in range(n))).alias("low"), F.array(*(F.max(F.col("d")[i]) for i in range(n))).alias("high")).orderBy("cell").collect()
    cells = np.array([b.cell for b in brackets])
    shards = np.array([-(-b.n // SHARD_ROWS) for b in brackets])
    low, high = np.array([b.low for b in brackets]), np.array([b.high for b in brackets])
    placed = placed.drop("d")
    anchors = stored(placed.where(is_anchor), "negatives-anchors")
    crowds = {r.cell: -(-r.n // CROWD_ROWS) for r in anchors.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    def reach(column: str, home: bool | None) -> DataFrame:
        """Anchors with the cells (array) that may hold scores of at least ``column``: all, their own only, or the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in tidied(batches):
                near, norm = batch.column("cell").to_numpy(), batch.column("norm").to_numpy()
                least = np.asarray(batch.column("least").to_numpy(zero_copy_only=False), np.float64)
                asked = pivots.asked(_matrix(batch.column("vector"))) if batch.num_rows else np.zeros((0, n))
                reached = pivots.upper(norm, asked, low, high) >= least[:, None]
                own = cells[None] == near[:, None]
                reached = own if home else reached & ~own if home is False else reached
                hit = [[f"{c}-{s}" for c, k in zip(cells[on].tolist(), shards[on].tolist(), strict=True) for s in range(k)] for on in reached]
                yield pa.record_batch([*batch.columns, pa.array(hit, pa.list_(pa.string()))], [*batch.schema.names, "shards"])

        kinds = ", ".join(f"{c} {t}" for c, t in given.dtypes)
        return given.withColumn("least", F.col(column).cast("double")).mapInArrow(run, f"{kinds}, least double, shards array<string>").drop("least")

    def dealt(of: dict[int, int]) -> Column:
        """The cell and a number below what ``of`` has for it."""
        by_cell = F.create_map(*(F.lit(int(x)) for pair in of.items() for x in pair))
        return F.concat_ws("-", "cell", F.pmod(F.xxhash64("vec_id"), by_cell[F.col("cell")]))

    right = placed.select("vec_id", "label", "vector", "distances", dealt(dict(zip(cells.tolist(), shards.tolist(), strict=True))).alias("shard"))
    anchors = anchors.withColumn("crowd", dealt(crowds)) if crowds else anchors.withColumn("crowd", F.lit(""))

    def searched(asked: DataFrame, work, schema: str) -> DataFrame:
        """Run ``work(shard, anchors)`` for every shard and crowd of anchors that reach it."""

        def run(some: pa.Table, others: pa.Table) -> pa.Table:
            if not some.num_rows or not others.num_rows:
                return empty
            return work(Shard(others, pivots, exact), some)

        empty = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in schema.split(", ")})
        left = stored(asked.withColumn("shard", F.explode("shards")).drop("shards"), "negatives-asked")
        # Rows go to the crowds that reach them; a shard is as small as a crowd is.
        there = right.join(left.select("shard", F.col("crowd").alias("asking")).distinct(), "shard")
        return left.groupBy("shard", "crowd").cogroup(there.groupBy("shard", "asking")).applyInArrow(run, schema)

    def operands(some: pa.Table) -> tuple:
        a = _matrix(some.column("vector"))
        return a, some.column("norm").to_numpy(), pivots.asked(a)

    def same_label(shard: Shard, some: pa.Table) -> pa.Table:
        found = []
        labels, ids = some.column("label").to_numpy(), some.column("vec_id").to_numpy()
        least = np.array([-np.inf if x is None else x for x in some.column("bound").to_pylist()], np.float64)
        a, norms, asked = operands(some)
        for i, (rows, score) in enumerate(shard.survivors(a, norms, asked, least, np.full(len(ids), np.inf))):
            wanted = np.flatnonzero((shard.labels[rows] == labels[i]) & (shard.ids[rows] != ids[i]))[:n_positives]
            found.append((np.full(len(wanted), ids[i]), shard.ids[rows[wanted]], score[wanted]))
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], ["anchor_id", "other_id", "score"])

    def top(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
        return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_positives)

    given = anchors.withColumn("bound", F.lit(None).cast("long"))
    near = stored(searched(reach("bound", True).drop("distances", "cell"), same_label, FOUND), "negatives-near")
    # The last of n positives in the own cell bounds those of the other cells.
    bound = top(near).groupBy("anchor_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == n_positives)
    given = stored(anchors.join(bound.select(F.col("anchor_id").alias("vec_id"), "bound"), "vec_id", "left"), "negatives-bounds")
    given = given.withColumn("bound_or_less", F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf"))))
    far = stored(searched(reach("bound_or_less", False).drop("distances", "cell", "bound_or_less"), same_label, FOUND), "negatives-far")
    chosen = stored(top(near.unionByName(far)).drop("r"), "negatives-positives")

    def other_labels(shard: Shard, some: pa.Table) -> pa.Table:
        found = []
        labels, ids, wished = some.column("label").to_numpy(), some.column("vec_id").to_numpy(), some.column("positives").to_pylist()
        a, norms, asked = operands(some)
        # Scores that any positive asks for; those of a positive are a range of them.
        ranges = [[(_floor_ratio(p["score"], percent[0], 100), percent[1] * p["score"] // 100, p) for p in ps] for ps in wished]
        least = np.array([min((lo for lo, hi, _ in r if lo <= hi), default=np.inf) for r in ranges], np.float64)
        most = np.array([max((hi for lo, hi, _ in r if lo <= hi), default=-np.inf) for r in ranges], np.float64)
        for i, (rows, score) in enumerate(shard.survivors(a, norms, asked, least, most)):
            other = shard.labels[rows] != labels[i]
            rows, score = rows[other], score[other]
            for lo, hi, p in ranges[i]:
                if lo <= hi:
                    first, end = np.searchsorted(-score, [-hi, 1 - lo], "left")
                    mine = slice(first, min(end, first + n_negatives))
                    each = np.ones(len(rows[mine]), np.int64)
                    found.append((each * ids[i], each * p["other_id"], each * p["score"], shard.ids[rows[mine]], score[mine]))
        if not found:
            return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in BRACKETED.split(", ")})
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], [c.split()[0] for c in BRACKETED.split(", ")])

    wished = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "score")).alias("positives"), F.min(F.col("score").cast("double") * percent[0] / 100).alias("bound"))
    given = stored(anchors.join(wished.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "negatives-wished")
    mined = searched(reach("bound", None).drop("distances", "cell", "bound"), other_labels, BRACKETED)
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
