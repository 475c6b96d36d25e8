"""Time, number, vector and JSON functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def utc_timestamp(text: Column) -> Column:
    """A timestamp given with Z or an offset; null where the zone is missing or the text isn't a time."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(x + 0.5)


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, summed in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x
    )


def string_array(text: Column) -> Column:
    """A JSON array of strings; empty where it is malformed, elements that are null are dropped."""
    return F.array_compact(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")))


def bucket_start(ts: Column, granularity: str) -> Column:
    if granularity not in ("hour", "day"):
        raise ValueError(f"granularity is hour or day, not {granularity!r}")
    return F.date_trunc(granularity, ts)


def slice_start(ts: Column, minutes: int = 10) -> Column:
    return F.window(ts, f"{minutes} minutes")["start"]


def cron_lookback_minutes(cron: Column) -> Column:
    """How far back a routine looks: a week, a month, a day or an hour, by the most specific field that is set."""
    raw = F.split(F.trim(cron), r"\s+")
    fields = F.when(F.size(raw) == 6, F.slice(raw, 2, 5)).otherwise(raw)
    is_set = lambda i: F.get(fields, F.lit(i)) != "*"
    return F.when(F.size(fields) < 5, 60).when(is_set(4), 10080).when(is_set(2), 43200).when(is_set(1), 1440).otherwise(60)


def privacy_range_start(keyword: Column, now: Column) -> Column:
    return (
        F.when(keyword == "last_1h", now - F.expr("interval 1 hour"))
        .when(keyword == "last_1d", now - F.expr("interval 1 day"))
        .when(keyword == "all", F.lit("0001-01-01 00:00:00").cast("timestamp"))
    )


def duration_seconds(text: str) -> int:
    """'90', '90s', '15m', '2h' or '1d' as seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def clamp_limit(limit: float | None, default: int = 20, most: int = 100) -> int:
    """A result limit: the default where it is missing, not finite or not positive; floored and cut at the maximum."""
    if limit is None or limit != limit or limit in (float("inf"), float("-inf")) or limit <= 0:
        return default
    return min(int(limit), most)
