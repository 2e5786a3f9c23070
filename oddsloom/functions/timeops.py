"""Time columns.  The present is always passed in, so that results can be had again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Horizons and their lengths in hours, tightest first.
HORIZONS = (("24h", 24), ("7d", 168), ("30d", 720))
YEAR_SECONDS = 365.25 * 86400


def at(moment: str) -> Column:
    """A timestamp literal in UTC."""
    return F.lit(moment).cast("timestamp")


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, as a double."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def hours_until(when: Column, now: Column) -> Column:
    return seconds_between(now, when) / 3600


def years_until(when: Column, now: Column) -> Column:
    """Years of 365.25 days, never below 0; 0 where unknown."""
    return F.greatest(F.coalesce(seconds_between(now, when) / YEAR_SECONDS, F.lit(0.0)), F.lit(0.0))


def age_seconds(when: Column, now: Column) -> Column:
    return F.greatest(seconds_between(when, now), F.lit(0.0))


def horizon(when: Column, now: Column) -> Column:
    """The tightest horizon that holds a moment, its end included; null if past, beyond or unknown."""
    h = hours_until(when, now)
    out = F.when(h < 0, F.lit(None))
    for name, hours in HORIZONS:
        out = out.when(h <= hours, name)
    return out


def horizons(when: Column, now: Column) -> Column:
    """That horizon and all wider ones."""
    h = hours_until(when, now)
    return F.array_compact(F.array(*(F.when((h >= 0) & (h <= hours), name) for name, hours in HORIZONS)))


def parse_moment(text: Column) -> Column:
    """ISO text, epoch seconds, or epoch milliseconds (over 1e11); anything else is null."""
    number = text.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), F.try_to_timestamp(text))


def humanized(seconds: Column) -> Column:
    """A short duration: 45s, 12m, 3h, 2d."""
    return (
        F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d")))
    )
