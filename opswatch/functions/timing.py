"""Time arithmetic and duration labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def instant(value) -> Column:
    """A timestamp column from a column, a datetime or ISO text; text is read as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.lit(value).cast("timestamp")
    return F.lit(value)


def seconds_between(later, earlier) -> Column:
    """``later - earlier`` in seconds with microsecond precision."""
    return (F.unix_micros(instant(later)) - F.unix_micros(instant(earlier))) / F.lit(float(MICROS))


def age_seconds(ts: Column, now) -> Column:
    return seconds_between(now, ts)


def millis_between(later, earlier) -> Column:
    """Whole milliseconds between two instants, truncated toward zero."""
    return ((F.unix_micros(instant(later)) - F.unix_micros(instant(earlier))) / F.lit(1000)).cast("long")


def shift(ts, seconds) -> Column:
    """``ts`` moved by a number of seconds (column or number), microsecond precision."""
    delta = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros((F.unix_micros(instant(ts)) + (delta * F.lit(MICROS).cast("long"))).cast("long"))


def whole(x: Column) -> Column:
    """Round half away from zero to a whole number."""
    return F.round(x, 0).cast("long")


def duration_text(seconds: Column) -> Column:
    """Whole seconds as ``45s``, ``5m0s`` or ``1h0m0s``."""
    s = F.abs(seconds.cast("long"))
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    hours, minutes, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    body = (
        F.when(hours > 0, F.format_string("%dh%dm%ds", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm%ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )
    return F.concat(sign, body)


def literal_duration(seconds: int) -> str:
    """The same text for a fixed number of seconds."""
    hours, minutes, rest = seconds // 3600, seconds % 3600 // 60, seconds % 60
    if hours:
        return f"{hours}h{minutes}m{rest}s"
    return f"{minutes}m{rest}s" if minutes else f"{rest}s"


def utc_text(ts: Column) -> Column:
    """ISO text to the second, e.g. ``2024-01-31T00:00:00Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def number_text(x: Column) -> Column:
    """Shortest decimal text of a double: no exponent and no trailing ``.0``."""
    return F.regexp_replace(x.cast("decimal(38,9)").cast("string"), r"\.?0+$", "")


# --- labels ---


def age_label(seconds: Column) -> Column:
    """``42s``, ``3m`` or ``5h``, rounded down and never negative."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
    )


def lag_label(seconds: Column) -> Column:
    """``<1s``, then seconds below 2 minutes, minutes below 2 hours, hours above, each rounded."""
    return (
        F.when(seconds < 1, F.lit("<1s"))
        .when(seconds < 120, F.concat(whole(seconds).cast("string"), F.lit("s")))
        .when(seconds < 7200, F.concat(whole(seconds / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(whole(seconds / 3600).cast("string"), F.lit("h")))
    )


def lateness_label(seconds: Column) -> Column:
    """``—`` when unknown, else ``42s``, ``3m``, ``3m 5s``, ``2h`` or ``2h 5m``."""
    s = F.greatest(whole(seconds), F.lit(0))
    minutes, rest = F.floor(s / 60), F.pmod(s, F.lit(60))
    hours, hour_rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return (
        F.when(seconds.isNull() | F.isnan(seconds), F.lit("—"))
        .when(s < 60, F.format_string("%ds", s))
        .when((s < 3600) & (rest == 0), F.format_string("%dm", minutes))
        .when(s < 3600, F.format_string("%dm %ds", minutes, rest))
        .when(hour_rest == 0, F.format_string("%dh", hours))
        .otherwise(F.format_string("%dh %dm", hours, hour_rest))
    )


def throughput_label(per_minute: Column) -> Column:
    """``—`` when unknown, ``0/min``, one decimal below 10, whole numbers above."""
    return (
        F.when(per_minute.isNull() | F.isnan(per_minute), F.lit("—"))
        .when(per_minute == 0, F.lit("0/min"))
        .when(per_minute < 10, F.concat(F.format_string("%.1f", per_minute.cast("double")), F.lit("/min")))
        .otherwise(F.concat(whole(per_minute).cast("string"), F.lit("/min")))
    )
