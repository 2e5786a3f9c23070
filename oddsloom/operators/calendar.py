"""Trading sessions as columns: cash and overnight hours between two moments.

Moments are in UTC; the session's time zone must be UTC as well.  Days and quarter hours come from
``sequence`` and are folded within a row, so nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: Days on which the exchange is closed, and those on which it closes at 13:00.
HOLIDAYS = (
    "2025-01-01", "2025-01-09", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
)
EARLY_CLOSES = ("2025-07-03", "2025-11-28", "2025-12-24", "2026-11-27", "2026-12-24", "2027-11-26")
#: Hours of a session, and of the night before it in which futures trade; what an hour of these weighs; days of a year.
CASH_HOURS, NIGHT_HOURS, NIGHT_WEIGHT, YEAR_DAYS = 6.5, 16.5, 0.10, 252
YEAR_HOURS = YEAR_DAYS * (CASH_HOURS + NIGHT_HOURS * NIGHT_WEIGHT)
#: Nights are measured over thirty days at most, as far as ranked horizons go.
NIGHT_DAYS = 30


def eastern(moment: Column) -> Column:
    """The wall clock in New York."""
    return F.from_utc_timestamp(moment, ZONE)


def is_trading_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~day.cast("string").isin(*HOLIDAYS)


def _clock(moment: Column) -> Column:
    """Seconds since midnight."""
    return F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)


def session_open(moment: Column) -> Column:
    """Whether the exchange is open at a wall-clock moment."""
    day = F.to_date(moment)
    close = F.when(day.cast("string").isin(*EARLY_CLOSES), 13 * 3600).otherwise(16 * 3600)
    return is_trading_day(day) & (_clock(moment) >= 9 * 3600 + 1800) & (_clock(moment) < close)


def futures_open(moment: Column) -> Column:
    """Whether index futures trade: Sunday 18:00 to Friday 17:00, but for an hour from 17:00 on each day."""
    day, clock = F.weekday(moment), _clock(moment)
    return F.when(day == 5, False).when(day == 6, clock >= 18 * 3600).when(day == 4, clock < 17 * 3600).otherwise((clock < 17 * 3600) | (clock >= 18 * 3600))


def cash_hours(start: Column, end: Column) -> Column:
    """Hours of open sessions between two moments; 0 where the end is not later."""
    a, b = eastern(start), eastern(end)

    def overlap(day: Column) -> Column:
        at = lambda hour, minute: F.unix_seconds(day.cast("timestamp")) + hour * 3600 + minute * 60
        close = F.when(day.cast("string").isin(*EARLY_CLOSES), at(13, 0)).otherwise(at(16, 0))
        width = F.least(F.unix_micros(b) / 1e6, close) - F.greatest(F.unix_micros(a) / 1e6, at(9, 30))
        return F.when(is_trading_day(day), F.greatest(width, F.lit(0.0)) / 3600).otherwise(0.0)

    days = F.sequence(F.to_date(a), F.to_date(b))
    return F.when(end > start, F.aggregate(days, F.lit(0.0), lambda s, d: s + overlap(d))).otherwise(0.0)


def overnight_hours(start: Column, end: Column) -> Column:
    """Hours in which futures trade and the exchange is closed, told at the middle of each quarter of an hour.

    How many of these middles lie in a stretch of the night follows from its ends, so a day is a few
    differences, whatever the number of its quarters; the last, shorter step is told on its own.
    """
    step = 15 * 60 * 1_000_000
    a = F.unix_micros(eastern(start))
    b = F.least(F.unix_micros(eastern(end)), a + F.lit((NIGHT_DAYS * 96 + 8) * step).cast("long"))
    full = F.floor((b - a) / step)

    def night(day: Column) -> Column:
        midnight = F.unix_micros(day.cast("timestamp"))
        before = lambda hour: F.least(F.greatest(F.ceil((midnight + (hour * F.lit(3_600_000_000)).cast("long") - a - step // 2) / step), F.lit(0)), full)  # noqa: E731  middles before a time of day
        weekday, open_ = F.weekday(day), is_trading_day(day)
        close = F.when(day.cast("string").isin(*EARLY_CLOSES), 13).otherwise(16)
        morning = F.when(weekday < 5, before(F.when(open_, 9.5).otherwise(17.0)) - before(F.lit(0))).otherwise(0)
        afternoon = F.when(open_, before(F.lit(17)) - before(close)).otherwise(0)
        evening = F.when((weekday < 4) | (weekday == 6), before(F.lit(24)) - before(F.lit(18))).otherwise(0)
        return morning + afternoon + evening

    days = F.sequence(F.to_date(eastern(start)), F.to_date(F.timestamp_micros(b)))
    steps = F.aggregate(days, F.lit(0).cast("long"), lambda s, d: s + night(d))
    low = a + full * step
    middle = F.timestamp_micros((low + (b - low) / 2).cast("long"))
    rest = F.when((b > low) & futures_open(middle) & ~session_open(middle), (b - low) / 3.6e9).otherwise(0.0)
    return F.when(end > start, steps * (step / 3.6e9) + rest).otherwise(0.0)


def volatility_years(cash: Column, overnight: Column) -> Column:
    """Years in which a yearly volatility of daily closes acts: a night's hour weighs a tenth of a session's."""
    return (cash + NIGHT_WEIGHT * overnight) / YEAR_HOURS
