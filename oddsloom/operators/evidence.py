"""Strict parsing of research answers: JSON is read as VARIANT, every field has its type, and a refusal has its reason.

Nothing is repaired.  An answer that breaks the contract anywhere gives no evidence at all, and says where.  Only numbers
are lenient, as the contract says: a probability that is none is missing, a confidence that is none is 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp_prob

#: How a source bears on the question, and words for yes and no.
STANCES = ("supports_yes", "supports_no", "neutral", "conflicting")
YES, NO = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")
#: Characters of a source's name at most, and the quality of a source that states none.
LONGEST_NAME, DEFAULT_QUALITY = 200, 0.5
NUMBERS = ("DECIMAL", "BIGINT", "DOUBLE", "FLOAT")


def _kind(value: Column, path: str) -> Column:
    """The type of what is at a path: null where there is nothing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _text(value: Column, path: str) -> Column:
    return F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def _text_or_absent(value: Column, path: str) -> Column:
    return F.coalesce(_kind(value, path) == "STRING", F.lit(True))


def _number(value: Column, path: str) -> Column:
    """A number, or a text that is one; null else."""
    kind = _kind(value, path)
    numeric = reduce(lambda o, k: o | F.startswith(kind, F.lit(k)), NUMBERS[1:], F.startswith(kind, F.lit(NUMBERS[0])))
    found = F.when(numeric, F.try_variant_get(value, path, "double")).when(kind == "STRING", F.trim(F.try_variant_get(value, path, "string")).try_cast("double"))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def _flag(value: Column, path: str) -> Column:
    """A boolean, or a word or number for one; null for anything else."""
    said = F.lower(F.trim(F.try_variant_get(value, path, "string")))
    return F.when(said.isin(*YES), True).when(said.isin(*NO), False)


def _list(value: Column, path: str) -> Column:
    """The values of a list; empty where there is nothing, null where there is something else."""
    kind = _kind(value, path)
    return F.when(kind.isNull(), F.array().cast("array<variant>")).when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(value, path, "array<variant>"))


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def parsed(answers: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``answers`` with what their text says: refused (why, or null), question, probability, confidence, sources, n_yes, n_no, n_conflicts, n_novel and quality.

    The text may stand in a fence and among other words; what counts is what lies between its first and its last brace.
    Refusals, in order: empty, no_object, not_json, not_an_object, then the name of the first field that is wrong.
    """
    plain = F.regexp_replace(F.trim(F.col(text)), r"(?m)^```(?:json)?\s*|\s*```$", "")
    plain = F.when(F.startswith(F.trim(F.col(text)), F.lit("```")), plain).otherwise(F.trim(F.col(text)))
    rows = answers.withColumn("__body", F.regexp_extract(plain, r"(?s)(\{.*\})", 1))
    rows = rows.withColumn("__v", F.try_parse_json(F.nullif("__body", F.lit(""))))
    v = F.col("__v")
    rows = rows.withColumn("__sources", _list(v, "$.sources"))
    texts = {n: _list(v, f"$.{n}") for n in ("supports_yes", "supports_no", "conflicts")}
    all_text = lambda values: F.coalesce(F.forall(values, lambda x: _kind(x, "$") == "STRING"), F.lit(False))
    source_ok = lambda s: (
        F.coalesce(F.length(_text(s, "$.name")).between(1, LONGEST_NAME), F.lit(False))
        & _text_or_absent(s, "$.url") & _text_or_absent(s, "$.title") & _text_or_absent(s, "$.summary")
        & (_kind(s, "$.stance").isNull() | F.coalesce(_text(s, "$.stance").isin(*STANCES), F.lit(False)))
        & (_kind(s, "$.is_novel").isNull() | _flag(s, "$.is_novel").isNotNull())
    )
    refused = (
        F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "empty")
        .when(F.col("__body") == "", "no_object")
        .when(v.isNull(), "not_json")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_an_object")
        .when(~_text_or_absent(v, "$.decisive_question"), "decisive_question")
        .when(F.col("__sources").isNull() | ~F.coalesce(F.forall("__sources", source_ok), F.lit(True)), "sources")
    )
    for name, values in texts.items():
        refused = refused.when(~all_text(values), name)
    refused = refused.when(~_text_or_absent(v, "$.reasoning"), "reasoning")
    rows = rows.withColumn("refused", refused)
    ok = F.col("refused").isNull()
    source = lambda s: F.struct(
        _text(s, "$.name").alias("name"),
        F.coalesce(_text(s, "$.url"), F.lit("")).alias("url"),
        F.coalesce(_text(s, "$.stance"), F.lit("neutral")).alias("stance"),
        F.try_to_timestamp(_text(s, "$.published_at")).alias("published_at"),
        F.coalesce(_flag(s, "$.is_novel"), F.lit(True)).alias("is_novel"),
        _clamped(F.coalesce(_number(s, "$.source_quality"), F.lit(DEFAULT_QUALITY))).alias("quality"),
    )
    rows = rows.withColumn("sources", F.when(ok, F.transform("__sources", source)))
    novel = F.filter("sources", lambda s: s["is_novel"])
    best = lambda xs: F.array_max(F.transform(xs, lambda s: s["quality"]))
    quality = F.when(F.size("sources") == 0, 0.0).when(F.size(novel) == 0, F.least(F.lit(0.25), best(F.col("sources"))))
    quality = quality.otherwise(F.least(F.lit(1.0), best(novel) * (0.7 + 0.3 * F.least(F.size(novel) / 3, F.lit(1.0)))))
    return rows.select(
        *answers.columns, "refused",
        F.when(ok, F.coalesce(_text(v, "$.decisive_question"), F.lit(""))).alias("question"),
        F.when(ok, clamp_prob(_number(v, "$.probability"))).alias("probability"),
        F.when(ok, _clamped(F.coalesce(_number(v, "$.self_reported_confidence"), F.lit(0.0)))).alias("confidence"),
        "sources",
        *(F.when(ok, F.size(texts[n])).alias(a) for n, a in (("supports_yes", "n_yes"), ("supports_no", "n_no"), ("conflicts", "n_conflicts"))),
        F.when(ok, F.size(novel)).alias("n_novel"),
        F.when(ok, quality).alias("quality"),
    )
