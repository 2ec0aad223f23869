"""Durations and clocks. Milliseconds are integers; seconds become milliseconds by rounding half to even."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import half_even


def to_ms(seconds: Column) -> Column:
    return F.rint(seconds * 1000).cast("long")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds from 1970 by date and time of day, whatever the session's time zone; half a millisecond goes away from 1970."""
    us = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.round(us.cast("decimal(20,0)") / 1000).cast("long")


def span(start: Column, stop: Column) -> Column:
    return F.greatest(F.lit(0), stop - start)


def smil_clock(ms: Column) -> Column:
    """2340 as 2.340s; negative milliseconds are an error."""
    ok = F.when(ms < 0, F.raise_error(F.lit("negative clock"))).otherwise(ms)
    return F.format_string("%d.%03ds", F.floor(ok / 1000).cast("long"), F.pmod(ok, F.lit(1000)))


def parse_clock(clock: Column) -> Column:
    """Seconds of 1.5s, 1.5, 02:03.5 or 01:02:03.5; null if it is none of these."""
    c = F.trim(clock)
    part = lambda i: F.get(F.split(c, ":"), F.lit(i)).try_cast("double")
    n = F.size(F.split(c, ":"))
    return (
        F.when(c.endswith("s"), F.rtrim(c, F.lit("s")).try_cast("double"))
        .when(n == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(n == 2, part(0) * 60 + part(1)).otherwise(c.try_cast("double"))
    )


def hms_clock(ms: Column) -> Column:
    """3723456 as 01:02:03.456; negative values count as 0, hours are unbounded."""
    ms = F.greatest(F.lit(0), ms).cast("long")
    at = lambda unit: F.floor(ms / unit).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", at(3_600_000), at(60_000) % 60, at(1000) % 60, ms % 1000)


def readable(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    return (
        F.when(s < 0.001, "< 1ms").when(s < 1, F.format_string("%.0fms", half_even(s * 1000, 0))).when(s < 60, F.format_string("%.2fs", half_even(s, 2)))
        .when(s < 3600, F.format_string("%dm %.1fs", F.floor(s / 60).cast("long"), half_even(s % 60, 1)))
        .otherwise(F.format_string("%dh %dm %.0fs", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), half_even(s % 60, 0)))
    )
