"""JSON written in columns, always in one way: sorted keys, a blank after commas and colons, characters beyond ASCII escaped."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """A text as a JSON string; null for null."""
    quoted = F.to_json(F.array(text))
    quoted = F.substring(quoted, 2, F.length(quoted) - 2)
    for digit in "ABCDEF":  # control characters are written in lower case; a backslash of the text is two
        quoted = F.regexp_replace(quoted, r"(?<!\\)((?:\\\\)*)\\u00([01])" + digit, r"$1\\u00$2" + digit.lower())
    # Characters beyond ASCII, by their UTF-16 units.
    unit = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = F.concat_ws("", F.transform(F.regexp_extract_all(quoted, F.lit("(?s)(.)"), 1), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), unit(c)).otherwise(c)))
    return F.when(text.isNotNull(), F.when(quoted.rlike(r"[^\x00-\x7F]"), escaped).otherwise(quoted))


def json_boolean(flag: Column) -> Column:
    return flag.cast("string")


def json_strings(texts: Column) -> Column:
    """An array of texts as a JSON list."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, lambda x: F.coalesce(json_string(x), F.lit("null"))), ", "), F.lit("]"))


def json_object(fields: Mapping[str, Column]) -> Column:
    """An object of columns that hold JSON; a null column is written as null."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(f'{", " if i else ""}"{name}": '), F.coalesce(fields[name], F.lit("null"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def plain_number(value: Column) -> Column:
    """A decimal number without zeros at its end; null for what is no number."""
    text = value.cast("string").try_cast("decimal(38,10)").cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
