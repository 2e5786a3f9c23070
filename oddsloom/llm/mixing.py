"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source has a target number of words.  A document of it is copied ``floor(target / size of the
source)`` times for sure and once more with the probability that is left over.  Those probabilities
are rounded together: two documents exchange mass (words times probability) until one of them has
probability 0 or 1, and the other goes on to the next exchange.  The direction is random, with odds
that keep every expectation, and the words of the pair stay the same; so the words taken from a
source differ from its target by less than its last document.

The exchanges form a reduction tree: documents fall into chunks of about ``FAN`` by a hash, each chunk
is folded to one undecided document, and those are the documents of the next level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import body, stored

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one fold of the tree takes, on average.
FAN = 128
#: Targets of at most so many sources are broadcast.
BROADCAST_SOURCES = 100_000


def word_count(column: str = "text") -> Column:
    return F.regexp_count(body(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """Targets of the sources of ``sizes`` (source string, size long).

    Sources in code-point order (null last) weigh 1, 2, 3, 1, ...; the weights share the sum of all
    sizes.  No target exceeds ``most`` times its source's size; what is cut off is shared by weight
    among the others, until none is above.  That is a common water level: target = least(cap, level *
    weight), with the level found from running sums over the sources by cap / weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n_units"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    free = weighed.withColumn("level", level).withColumn("level", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level")))
    free = free.withColumn("level", F.max("level").over(everything))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return free.select("source", "source_size", "n_units", target.alias("target"))


def _uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _exchange(seed: int):
    """One step of a fold: the carried document and the next exchange mass; the one that becomes integral is decided."""

    def unit(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["dup"].alias("dup"), p.alias("p"))

    def step(held: Column, b: Column) -> Column:
        a = held["carry"]
        room_a, room_b = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
        mass_a, mass_b = a["p"] * a["size"], b["p"] * b["size"]
        up, down = F.least(room_a, mass_b), F.least(room_b, mass_a)
        to_a = _uniform(seed, a["doc_id"], a["size"], a["dup"], b["doc_id"], b["size"], b["dup"]) * (up + down) < down
        fills_a, fills_b = room_a <= mass_b, room_b <= mass_a
        # to_a: a reaches 1 or b reaches 0; else b reaches 1 or a reaches 0.
        decide = (
            F.when(to_a & fills_a, F.struct(unit(a, F.lit(1.0)).alias("done"), unit(b, (mass_b - room_a) / b["size"]).alias("carry")))
            .when(to_a, F.struct(unit(b, F.lit(0.0)).alias("done"), unit(a, (mass_a + mass_b) / a["size"]).alias("carry")))
            .when(fills_b, F.struct(unit(b, F.lit(1.0)).alias("done"), unit(a, (mass_a - room_b) / a["size"]).alias("carry")))
            .otherwise(F.struct(unit(a, F.lit(0.0)).alias("done"), unit(b, (mass_a + mass_b) / b["size"]).alias("carry")))
        )
        return F.element_at(F.transform(F.array(decide), lambda d: F.struct(d["carry"].alias("carry"), F.array_append(held["done"], d["done"]).alias("done"))), 1)

    return step


def pivotal_round(units: DataFrame, levels: int, seed: int = 7, fan: int = FAN) -> DataFrame:
    """Round the probabilities of ``units`` together, within each source.

    ``units`` has source, doc_id, size (over 0), dup (numbers rows that are alike), p in [0, 1] and
    n_units (of its source).  Returns source, doc_id, size, dup, take (0 or 1).
    """
    fields = ("doc_id", "size", "dup", "p")
    decided = None
    for level in range(levels):
        chunks = F.ceil(F.col("n_units") / F.lit(float(fan) ** (level + 1)))
        dealt = units.withColumn("mix", F.xxhash64(F.lit(seed + level), "doc_id", "size", "dup")).withColumn("chunk", F.pmod("mix", chunks))
        rows = dealt.groupBy("source", "n_units", "chunk").agg(F.array_sort(F.collect_list(F.struct("mix", *fields))).alias("rows"))
        plain = F.transform("rows", lambda x: F.struct(*(x[f].alias(f) for f in fields)))
        folded = rows.withColumn("rows", plain)
        start = F.struct(F.element_at("rows", 1).alias("carry"), F.slice("rows", 1, 0).alias("done"))
        folded = folded.select("source", "n_units", F.aggregate(F.slice("rows", 2, F.size("rows")), start, _exchange(seed)).alias("end"))
        folded = stored(folded, "pivotal")
        done = folded.select("source", F.explode("end.done").alias("u")).select("source", "u.doc_id", "u.size", "u.dup", (F.col("u.p") >= 0.5).cast("int").alias("take"))
        decided = done if decided is None else decided.unionByName(done)
        units = folded.select("source", "n_units", "end.carry.*")
    last = units.select("source", "doc_id", "size", "dup", (_uniform(seed, F.col("doc_id"), F.col("size"), F.col("dup")) < F.col("p")).cast("int").alias("take"))
    return last if decided is None else decided.unionByName(last)


def mix(docs: DataFrame, most: float = 3.0, seed: int = 7, fan: int = FAN) -> DataFrame:
    """Decide how often the mix takes each row of ``docs`` (doc_id long, text string, source string).

    Returns a row per row of ``docs``: doc_id, source, size (words), dup (0, 1, ... among rows with
    the same doc_id, source and size, which are interchangeable), source_size, target, copies, taken
    (copies times size).  Copies never exceed ``most`` rounded up.

    Null texts have size 0; documents of size 0 get 0 copies beyond the whole ones and take no words.
    Null sources are one source, the last.  The outcome depends on (doc_id, size, source) only, not on
    partitions or order.  An empty table gives an empty result.
    """
    sizes = stored(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    targets = stored(source_targets(sizes, most), "mix-targets")
    known = targets.agg(F.count("*").alias("n"), F.max("n_units").alias("most")).first()
    small = F.broadcast(targets) if known.n <= BROADCAST_SOURCES else targets
    alike = sizes.groupBy("doc_id", "source", "size").count()
    rows = alike.withColumn("dup", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1))).drop("count")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = small.withColumnRenamed("source", "of")
    rows = rows.join(named, rows.source.eqNullSafe(named.of)).drop("of").withColumn("rate", rate)
    whole = F.floor(F.col("rate") + 1e-12)
    rows = rows.withColumn("base", whole.cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - whole)).drop("rate")
    rows = stored(rows, "mix-units")
    levels = max(1, math.ceil(math.log(max(known.most or 1, 2), fan)))
    taken = pivotal_round(rows.where("size > 0 and p > 0").select("source", "doc_id", "size", "dup", "p", "n_units"), levels, seed, fan)
    keys = ("doc_id", "source", "size", "dup")
    taken = taken.select(*(F.col(k).alias(f"t_{k}") for k in keys), "take")
    both = rows.join(taken, (rows.doc_id.eqNullSafe(taken.t_doc_id)) & (rows.source.eqNullSafe(taken.t_source)) & (rows["size"] == taken.t_size) & (rows.dup == taken.t_dup), "left")
    copies = F.col("base") + F.coalesce("take", F.lit(0))
    return both.select(*keys, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row repeated as often as :func:`mix` takes it; rows taken no time are gone."""
    counts = mix(docs.select("doc_id", "text", "source"), **how).where("copies > 0")
    counts = counts.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("dup").alias("__dup"), F.col("copies").alias("__copies"))
    rows = docs.withColumn("__words", word_count())
    # Rows that are alike in text too stand for each other, so any numbering of them will do.
    rows = rows.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id", "source", "__words").orderBy("text")) - 1)
    both = rows.join(counts, rows.doc_id.eqNullSafe(counts["__id"]) & rows.source.eqNullSafe(counts["__source"]) & (rows["__words"] == counts["__size"]) & (rows["__row"] == counts["__dup"]))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
