"""Nearest neighbours by inner product: inverted lists, scanned a block of dimensions at a time.

Vectors are rotated at random, after which any block of their dimensions is a fair sample of all.
Within each probed list, inner products are summed over one block of dimensions after another; after
each block a hypothesis test asks whether what is still missing could lift a candidate over the
query's current k-th best, and candidates that fail are abandoned.  Near vectors agree in all blocks, so
the test holds the cosine that the missing block would need against the cosine seen so far; it does not
take the two for independent.  Survivors get their exact score from the original vectors, in double precision.

Every row is in a list.  A list is named by a coarse centre and by the centre nearest to what that one
leaves over; the number of the latter grows with the table, so lists keep their length at any size.
Centroids, the first bound of each query and the number of lists to probe
come from bounded samples; the last is the least that finds ``RECALL`` of the true neighbours of the
sampled queries, which are held against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidied

#: Rows that the centroids are fitted on, at most, and that the first bounds come from.
SAMPLE = 8192
#: Queries that the number of probed lists is fitted on, at most.
SAMPLE_QUERIES = 128
RECALL = 0.98
#: Rows of a list on average, coarse centres at most, and rows and queries of one piece of work.
LIST_ROWS, COARSE, SHARD_ROWS, SHARD_QUERIES = 256, 1024, 512, 512
#: Lists of which the plan of work is broadcast, at most; beyond that it is joined by shuffle.
BROADCAST_LISTS = 1 << 16
#: Dimensions of a column block, and the normal quantile of the test (one candidate of a thousand on the edge is lost at each block).
BLOCK, QUANTILE = 16, 3.1
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """vec_id and embedding (array<double>) of the vectors that take part.

    Null or zero vectors, vectors with null or non-finite components, and rows with a null vec_id take
    none; nor do vectors whose length is not ``dimension`` (where it is None, the most frequent one,
    of equally frequent ones the greatest).  Of rows with the same vec_id the greatest vector counts.
    """
    v = F.col("embedding")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    rows = rows.where(~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0))
    if dimension is None:
        first = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dimension = first.d if first else 0
    return rows.where(F.size("embedding") == dimension).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))


def rotation(d: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, n: int, rounds: int = 8, seed: int = 6) -> np.ndarray:
    """Centres of n clusters of the rows of x, by Lloyd's rounds from rows drawn at random."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return np.unique(c, axis=0)  # rows that are copies may have become equal centres


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centre nearest to each row of x."""
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


class Lists:
    """The centres of lists: list i * n_fine + j has the sum of coarse centre i and fine centre j."""

    def __init__(self, sample: np.ndarray, n: int):
        self.coarse = centroids(sample, int(min(COARSE, max(1, n // LIST_ROWS), len(sample))))
        fine = int(min(max(1, n // (LIST_ROWS * len(self.coarse))), len(sample)))
        left = sample - self.coarse[nearest(sample, self.coarse)]
        self.fine = centroids(left, fine, seed=7) if fine > 1 else np.zeros((1, sample.shape[1]))

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The list of each row of x."""
        i = nearest(x, self.coarse)
        j = nearest(x - self.coarse[i], self.fine) if len(self.fine) > 1 else 0
        return i.astype(np.int64) * len(self.fine) + j

    def best(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n lists of largest inner product with each row of q, best first.

        The p-th best sum of two has places i and j in the orders of both with (i + 1) * (j + 1) <= p.
        """
        n = min(n, len(self))
        a, b = q @ self.coarse.T, q @ self.fine.T
        first, second = np.argsort(-a, axis=1, kind="stable"), np.argsort(-b, axis=1, kind="stable")
        places = np.array([(i, j) for i in range(min(len(self.coarse), n)) for j in range(min(len(self.fine), n // (i + 1)))])
        i, j = first[:, places[:, 0]], second[:, places[:, 1]]
        order = np.argsort(-(np.take_along_axis(a, i, 1) + np.take_along_axis(b, j, 1)), axis=1, kind="stable")[:, :n]
        return np.take_along_axis(i.astype(np.int64) * len(self.fine) + j, order, 1)

    def place(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many lists come before list at[r] for query q[r]."""
        out = np.zeros(len(q), np.int64)
        for r in range(len(q)):
            a, b = self.coarse @ q[r], np.sort(self.fine @ q[r])
            i, j = divmod(int(at[r]), len(self.fine))
            score = a[i] + self.fine[j] @ q[r]
            out[r] = (len(b) - np.searchsorted(b, score - a + 1e-12 * (1 + abs(score)), "right")).sum()
        return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, d)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def promising(part: np.ndarray, seen: np.ndarray, rest: np.ndarray, bound: np.ndarray, n_seen: int, n_rest: int) -> np.ndarray:
    """Whether candidates with inner product ``part`` so far may still reach ``bound``.

    ``seen`` and ``rest`` are products of the lengths of both vectors in the dimensions summed and in those missing.
    After a random rotation both groups of dimensions show the same cosine but for chance.  By Fisher's transform the
    cosine that the missing ones would need differs from the one seen by at most so many deviations; what is beyond 1
    is out of reach.
    """
    if n_rest == 0:
        return part >= bound
    with np.errstate(divide="ignore", invalid="ignore"):
        needed, had = (bound - part) / rest, part / seen
    near = np.nextafter(1, 0)
    chance = np.sqrt(1 / max(n_seen - 2, 1) + 1 / max(n_rest - 2, 1))
    had = np.arctanh(np.clip(np.nan_to_num(had), -near, near))
    likely = np.arctanh(np.clip(np.nan_to_num(needed), -near, near)) - had <= QUANTILE * chance
    return (part + rest >= bound) & likely


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, same: np.ndarray, k: int, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates among the rows of x for each row of q: query, row and exact score of those not abandoned.

    ``bound``: a lower bound of each query's k-th best score; ``same``: pairs (query, row) of one id.
    """
    d = q.shape[1]
    qr, xr = q @ turn, x @ turn
    bound = bound - _slack(q, x)
    part = np.zeros((len(q), len(x)))
    seen_q, seen_x = np.zeros(len(q)), np.zeros(len(x))
    rest_q, rest_x = (qr * qr).sum(1), (xr * xr).sum(1)
    i = j = None
    for a in range(0, d, BLOCK):
        b = min(a + BLOCK, d)
        more_q, more_x = (qr[:, a:b] ** 2).sum(1), (xr[:, a:b] ** 2).sum(1)
        seen_q, seen_x = seen_q + more_q, seen_x + more_x
        rest_q, rest_x = np.maximum(rest_q - more_q, 0), np.maximum(rest_x - more_x, 0)
        if i is None:
            part += qr[:, a:b] @ xr[:, a:b].T
            outer = lambda m, n: np.sqrt(m)[:, None] * np.sqrt(n)[None]
            alive = promising(part, outer(seen_q, seen_x), outer(rest_q, rest_x), bound[:, None], b, d - b)
            if b == d or alive.mean() < 0.3:  # few are left: go on with pairs
                alive &= ~same
                i, j = np.nonzero(alive)
                sums = part[i, j]
        else:
            sums = sums + np.einsum("ij,ij->i", qr[i, a:b], xr[j, a:b])
            on = promising(sums, np.sqrt(seen_q[i] * seen_x[j]), np.sqrt(rest_q[i] * rest_x[j]), bound[i], b, d - b)
            i, j, sums = i[on], j[on], sums[on]
    return i, j, np.einsum("ij,ij->i", q[i], x[j])


def _slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What rounding may take from an inner product of each row of q."""
    return 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)


def _keep(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, i))
    first = np.searchsorted(i[order], i[order], "left")
    return order[np.arange(len(order)) - first < k]


def _top(k: int) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """The k nearest found of each query, by largest inner product: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` picks the queries among its rows.  Candidates are
    all rows but those with the query's vec_id.  Ties go to the smaller vec_id.  See :func:`usable` for
    the vectors that take no part; with fewer than k candidates, all are returned.  An empty table, or
    one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors), "vectors")
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    d = len(picked.column("embedding")[0])
    sample, sample_ids = _matrix(picked.column("embedding"), d), picked.column("vec_id").to_numpy()
    lists, turn = Lists(sample, n), rotation(d)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            x = _matrix(batch.column(1), d)
            yield pa.record_batch([pa.array(lists.of(x)), *batch.columns], ["list", "vec_id", "embedding"])

    placed = stored(rows.mapInArrow(assign, "list long, vec_id long, embedding array<double>"), "lists")
    queries = placed.where(is_query)
    probes = _probes(placed, queries, lists, d, k, recall)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                q, ids = _matrix(part.column(1), d), part.column(0).to_numpy()
                score = q @ sample.T
                score[ids[:, None] == sample_ids[None]] = -np.inf
                near = lists.best(q, probes)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(_best(score, k)), pa.array(list(near))], ["query_id", "query", "bound", "lists"])

    asked = stored(queries.select("vec_id", "embedding").mapInArrow(probe, "query_id long, query array<double>, bound double, lists array<long>"), "queries")
    asked = asked.withColumn("list", F.explode("lists")).drop("lists")
    shards = placed.groupBy("list").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("n_shards"))
    crowds = asked.groupBy("list").agg(F.ceil(F.count("*") / SHARD_QUERIES).cast("int").alias("n_crowds"))
    plan = stored(shards.join(crowds, "list"), "plan")
    plan = F.broadcast(plan) if len(lists) <= BROADCAST_LISTS else plan  # a row for each list
    deal = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = asked.join(plan, "list").withColumn("crowd", deal("query_id", "n_crowds")).withColumn("shard", every("n_shards"))
    right = placed.join(plan, "list").withColumn("shard", deal("vec_id", "n_shards")).withColumn("crowd", every("n_crowds"))

    def search(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        q, x = _matrix(some.column("query"), d), _matrix(others.column("embedding"), d)
        asked_ids, ids = some.column("query_id").to_numpy(), others.column("vec_id").to_numpy()
        i, j, score = scan(q, x, some.column("bound").to_numpy(), asked_ids[:, None] == ids[None], k, turn)
        best = _keep(i, score, ids[j], k)
        return pa.table([pa.array(asked_ids[i[best]]), pa.array(ids[j[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    keys = ("list", "crowd", "shard")
    found = left.select(*keys, "query_id", "query", "bound").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInArrow(search, FOUND)

    def from_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of the sample, which set the bounds: whatever is probed, there are as many results as candidates allow."""
        for batch in tidied(batches):
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                q, ids = _matrix(part.column(1), d), part.column(0).to_numpy()
                score = q @ sample.T
                score[ids[:, None] == sample_ids[None]] = -np.inf
                kth = _best(score, k)
                i, j = np.nonzero((score >= (kth - _slack(q, sample))[:, None]) & (ids[:, None] != sample_ids[None]))
                exact = np.einsum("ij,ij->i", q[i], sample[j])
                best = _keep(i, exact, sample_ids[j], k)
                yield pa.record_batch([pa.array(ids[i[best]]), pa.array(sample_ids[j[best]]), pa.array(exact[best])], ["query_id", "vec_id", "score"])

    sampled = queries.select("vec_id", "embedding").mapInArrow(from_sample, FOUND)
    every_one = found.unionByName(sampled).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return every_one.withColumn("rank", _top(k)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probes(placed: DataFrame, queries: DataFrame, lists: Lists, d: int, k: int, recall: float) -> int:
    """The least number of lists that holds ``recall`` of the true neighbours of the sampled queries."""
    picked = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(SAMPLE_QUERIES).select("vec_id", "embedding").toArrow()
    if not picked.num_rows:
        return 1
    q, ids = _matrix(picked.column("embedding"), d), picked.column("vec_id").to_numpy()

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            x, at, owner = _matrix(batch.column(2), d), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            score = q @ x.T
            score[ids[:, None] == owner[None]] = -np.inf
            i, j = np.nonzero((score >= _best(score, k)[:, None]) & np.isfinite(score))
            best = _keep(i, score[i, j], owner[j], k)
            yield pa.record_batch([pa.array(ids[i[best]]), pa.array(owner[j[best]]), pa.array(score[i[best], j[best]]), pa.array(at[j[best]])], ["query_id", "vec_id", "score", "list"])

    best = placed.mapInArrow(brute, FOUND + ", list long").withColumn("rank", _top(k)).where(F.col("rank") <= k).select("query_id", "list").toArrow()
    if not best.num_rows:
        return len(lists)
    row = {v: i for i, v in enumerate(ids)}
    asked = np.array([row[x] for x in best.column(0).to_pylist()])
    needed = np.sort(lists.place(q[asked], best.column(1).to_numpy()))
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1
