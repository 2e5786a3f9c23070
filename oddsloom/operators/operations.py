"""Running the platform: freshness, jobs, and checks on what was published."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Soft and hard limits of age by kind of data, in seconds.
FRESHNESS = {"orderbook": (300, 1800), "market": (1800, 7200), "probability": (7200, 28800), "settlement": (3600, 86400)}
#: Which jobs a job waits for.
JOBS = {"ingest": (), "orderbooks": ("ingest",), "score": ("orderbooks",), "rank": ("score",), "arbitrage": ("orderbooks",), "snapshot": ("rank",), "settle": ("ingest",), "backtest": ("settle", "snapshot")}
SUCCESS = ("succeeded", "partial")


def freshness(age: Column, kind: Column) -> Column:
    """fresh, aging, stale, or unavailable where the age or the kind is unknown."""
    out = F.when(age.isNull(), "unavailable")
    for name, (soft, hard) in FRESHNESS.items():
        out = out.when((kind == name) & (age <= soft), "fresh").when((kind == name) & (age <= hard), "aging").when(kind == name, "stale")
    return out.otherwise("unavailable")


def topological(jobs: Mapping[str, Sequence[str]] = JOBS) -> list[str]:
    """Jobs in an order in which each follows what it waits for; a cycle is an error."""
    order, left = [], {k: set(v) for k, v in jobs.items()}
    while left:
        ready = sorted(k for k, v in left.items() if not v - set(order))
        if not ready:
            raise ValueError(f"jobs wait for each other: {sorted(left)}")
        order += ready
        left = {k: v for k, v in left.items() if k not in order}
    return order


def upstream(jobs: Mapping[str, Sequence[str]] = JOBS) -> dict[str, list[str]]:
    """All jobs that a job waits for, directly or not."""
    out: dict[str, list[str]] = {}
    for job in topological(jobs):
        out[job] = sorted({*jobs[job], *(u for before in jobs[job] for u in out[before])})
    return out


def blocked_runs(runs: DataFrame, jobs: Mapping[str, Sequence[str]] = JOBS) -> DataFrame:
    """Runs (batch, job, status) of jobs of which one upstream job failed in the same batch: batch, job, failed."""
    waits = F.create_map(*(x for job, ups in upstream(jobs).items() for x in (F.lit(job), F.array(*map(F.lit, ups)).cast("array<string>"))))
    failed = runs.where("status = 'failed'").groupBy("batch").agg(F.collect_set("job").alias("__failed"))  # no more than there are jobs
    rows = runs.join(failed, "batch").withColumn("failed", F.array_sort(F.array_intersect(F.element_at(waits, F.col("job")), F.col("__failed"))))
    return rows.where(F.size("failed") > 0).select("batch", "job", "failed")


def doubly_active(runs: DataFrame) -> DataFrame:
    """Jobs with more than one active run: job and n."""
    return runs.where("status = 'running'").groupBy("job").agg(F.count("*").alias("n")).where("n > 1")


def partial_success(ok: Column, failed: Column) -> Column:
    """The status of a run over several providers."""
    return F.when(failed == 0, "succeeded").when(ok > 0, "partial").otherwise("failed")


def stalls(runs: DataFrame, cadence: Mapping[str, int], now: Column, slack: float = 2.0) -> DataFrame:
    """The last success of each job, and whether it is overdue by ``slack`` cadences: active, stalled or unknown."""
    good = runs.where(F.col("status").isin(*SUCCESS)).groupBy("job").agg(F.max("finished_at").alias("last"))
    every = F.create_map(*(F.lit(x) for pair in cadence.items() for x in pair))
    seen = runs.select("job").distinct().join(good, "job", "left").withColumn("every", F.element_at(every, F.col("job")))
    late = F.unix_seconds(now) - F.unix_seconds("last") > F.col("every") * slack
    return seen.withColumn("state", F.when(F.col("last").isNull() | F.col("every").isNull(), "unknown").when(late, "stalled").otherwise("active"))


def rolled_up(states: DataFrame) -> DataFrame:
    """One state for all jobs: any stalled is stalled, all active is active, else unknown."""
    stalled, active = F.max((F.col("state") == "stalled").cast("int")), F.min((F.col("state") == "active").cast("int"))
    return states.agg(F.when(stalled == 1, "stalled").when(active == 1, "active").otherwise("unknown").alias("state"))


def gaps(runs: DataFrame) -> DataFrame:
    """Seconds between the last two runs of each job."""
    w = Window.partitionBy("job").orderBy("finished_at", "run_id")
    rows = runs.withColumn("gap", F.unix_seconds("finished_at") - F.unix_seconds(F.lag("finished_at").over(w)))
    return rows.groupBy("job").agg(F.max_by("gap", F.struct("finished_at", "run_id")).alias("gap"), F.count("*").alias("n"))


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a rule, one for each rule they break: the row's columns and ``rule``."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), name) for name, test in rules.items())))
    return rows.withColumn("rule", F.explode(broken))


def reconciled(reasons: DataFrame, totals: DataFrame) -> DataFrame:
    """Groups whose counts by reason do not add up to the total that was reported."""
    g = reasons.groupBy("group").agg(F.sum("n").alias("summed"), F.count_distinct("reason").alias("reasons"), F.count("*").alias("rows"))
    both = totals.join(g, "group", "left")
    return both.where((F.coalesce("summed", F.lit(0)) != F.col("total")) | (F.coalesce("reasons", F.lit(0)) != F.coalesce("rows", F.lit(0))))
