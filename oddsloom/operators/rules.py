"""Rule inputs: what a market's normalised rules were made from, written once and replayed.

A provider stores the vector of inputs as canonical JSON.  Whoever writes the rules later makes them from that vector
and not from the market's columns, so the hash is the same by construction; :func:`replayed` finds rows where it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.canonical import json_boolean, json_object, json_string, json_strings, plain_number

#: The names of the inputs.
TEXTS = ("title", "subtitle", "description", "settlement_source", "explicit_comparator")
SCHEMA = ", ".join(f"{n} string" for n in (*TEXTS, "cutoff_time", "explicit_threshold")) + ", has_structured_strike boolean"
#: Terms that name the subject, of which the first so many go into the hash.
ENTITIES = 6


def rule_inputs(title: Column, subtitle: Column, description: Column, source: Column, cutoff: Column, threshold: Column, comparator: Column, structured: Column) -> Column:
    """The inputs as canonical JSON; missing texts are empty, a missing cutoff or threshold is null.  Times are in UTC."""
    texts = dict(zip(TEXTS, (title, subtitle, description, source, comparator), strict=True))
    fields = {name: json_string(F.coalesce(c, F.lit(""))) for name, c in texts.items()}
    fields["cutoff_time"] = json_string(F.date_format(cutoff, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    fields["explicit_threshold"] = json_string(plain_number(threshold))
    fields["has_structured_strike"] = json_boolean(F.coalesce(structured, F.lit(False)))
    return json_object(fields)


def _once(df: DataFrame, column: str) -> DataFrame:
    """The same rows; ``column`` is computed before what reads it, and not again at each place that does."""
    return df.select(*(c for c in df.columns if c != column), F.explode(F.array(column)).alias(column))


def with_rules(df: DataFrame, inputs: str) -> DataFrame:
    """Adds ``terms`` (what the rules come to), ``payload`` (their canonical JSON) and ``hash`` (32 digits), from a column of inputs.

    A venue's own strike and comparator rule.  Where it has a structured strike without a number, the condition is no
    number, and none is read from the title.  The cutoff counts by its hour.  All three are null for what is no JSON object.
    """
    df = _once(df.withColumn("__x", F.from_json(inputs, SCHEMA)), "__x")
    x = F.col("__x")
    get = lambda name: F.coalesce(x[name], F.lit(""))
    headline = F.trim(F.concat_ws(" ", get("title"), get("subtitle")))
    description, full = get("description"), F.trim(F.concat_ws(" ", headline, get("description")))
    either = lambda f: F.when(f(headline) != "", f(headline)).otherwise(f(description))
    stated = plain_number(F.nullif(x["explicit_threshold"], F.lit("")))
    read = F.when(~F.coalesce(x["has_structured_strike"], F.lit(False)), plain_number(F.get(T.thresholds(headline), F.lit(0))))
    named = F.when(get("settlement_source") != "", get("settlement_source")).otherwise(description)
    terms = F.struct(
        T.entities(T.normalize_title(headline)).alias("entities"),
        F.when(get("explicit_comparator") != "", get("explicit_comparator")).otherwise(either(T.comparator)).alias("comparator"),
        F.coalesce(stated, read).alias("threshold"),
        either(T.threshold_semantics).alias("semantics"),
        F.try_to_timestamp("__cutoff").alias("cutoff"),
        T.source_family(named).alias("source"),
        T.includes_overtime(full).alias("overtime"),
        T.uses_revised(full).alias("revised"),
    )
    rows = df.withColumn("__cutoff", x["cutoff_time"])
    is_object = F.startswith(F.trim(F.col(inputs)), F.lit("{")) & F.try_parse_json(inputs).isNotNull()
    rows = _once(rows.withColumn("terms", F.when(is_object, terms)).drop("__cutoff", "__x"), "terms")
    t = F.col("terms")
    payload = json_object(
        {
            "entities": json_strings(F.array_sort(F.slice(t["entities"], 1, ENTITIES))),
            "comparator": json_string(t["comparator"]),
            "threshold": json_string(F.coalesce(t["threshold"], F.lit(""))),
            "semantics": json_string(t["semantics"]),
            "cutoff": json_string(F.coalesce(F.date_format(t["cutoff"], "yyyy-MM-dd'T'HH"), F.lit(""))),
            "source": json_string(t["source"]),
            "overtime": json_boolean(t["overtime"]),
            "revised": json_boolean(t["revised"]),
        }
    )
    rows = rows.withColumn("payload", F.when(t.isNotNull(), payload))
    return rows.withColumn("hash", F.sha2("payload", 256).substr(1, 32))


def replayed(df: DataFrame, inputs: str, stored: str) -> DataFrame:
    """The rows with ``hash`` made anew from their inputs, and ``finding``: null, no_inputs, unreadable or changed."""
    rows = with_rules(df, inputs)
    finding = F.when(F.col(inputs).isNull(), "no_inputs").when(F.col("hash").isNull(), "unreadable").when(~F.col("hash").eqNullSafe(F.col(stored)), "changed")
    return rows.withColumn("finding", finding).drop("terms", "payload")
