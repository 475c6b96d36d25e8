"""Actions on privacy states: each takes states (paused, pause_started_at, excluded_apps, suppressed_ranges) and returns what they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RANGE = "struct<`from`:timestamp,`to`:timestamp,reason:string>"
RANGES = f"array<{RANGE}>"


def suppressed(start: Column, end: Column, reason: str) -> Column:
    """A range that is left out of results; one that would end before its start is its start alone."""
    return F.struct(start.alias("from"), F.greatest(start, end).alias("to"), F.lit(reason).alias("reason")).cast(RANGE)


def paused(states: DataFrame, now: Column) -> DataFrame:
    """Capture stands still from now on; a pause that runs keeps its start."""
    runs = F.col("paused") & F.col("pause_started_at").isNotNull()
    return states.withColumns({"pause_started_at": F.when(runs, F.col("pause_started_at")).otherwise(now), "paused": F.lit(True)})


def resumed(states: DataFrame, now: Column) -> DataFrame:
    """Capture goes on: the pause, to a millisecond before now, becomes a suppressed range."""
    over = suppressed(F.col("pause_started_at"), now - F.expr("interval 1 millisecond"), "pause")
    known = F.coalesce("suppressed_ranges", F.array().cast(RANGES))
    ranges = F.when(F.col("paused") & F.col("pause_started_at").isNotNull(), F.concat(known, F.array(over))).otherwise(known)
    return states.withColumns({"suppressed_ranges": ranges, "paused": F.lit(False), "pause_started_at": F.lit(None).cast("timestamp")})


def _is(app: Column):
    return lambda x: F.lower(F.trim(x)) == F.lower(F.trim(app))


def excluded(states: DataFrame, app: Column) -> DataFrame:
    """The app joins the excluded ones unless it, in any case, or no name at all, is given already."""
    name = F.trim(F.coalesce(app, F.lit("")))
    new = (name != "") & ~F.exists("excluded_apps", _is(name))
    return states.withColumn("excluded_apps", F.when(new, F.concat("excluded_apps", F.array(name))).otherwise(F.col("excluded_apps")))


def included(states: DataFrame, app: Column) -> DataFrame:
    """The app, in any case, is no longer excluded."""
    return states.withColumn("excluded_apps", F.filter("excluded_apps", lambda x: ~F.coalesce(_is(app)(x), F.lit(False))))


def tombstone(start: Column, end: Column, failed: Column, created: Column) -> Column:
    """What a deletion that failed leaves: its range is left out of results until it is tried again."""
    return F.struct(start.alias("from"), end.alias("to"), F.lit("cascade-failure").alias("reason"), failed.alias("failed_frame_ids"), created.alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"))


def unresolved(tombstones: DataFrame) -> DataFrame:
    """Failed deletions that are to be tried again: they alone hide results."""
    return tombstones.filter("reason = 'cascade-failure' AND resolved_at IS NULL")


def resolved(tombstones: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """tombstones (id, ...) with those of done (id) marked as resolved."""
    hit = done.select("id", F.lit(True).alias("_done")).distinct()
    return tombstones.join(hit, "id", "left").withColumn("resolved_at", F.when(F.coalesce("_done", F.lit(False)), F.coalesce("resolved_at", now)).otherwise(F.col("resolved_at"))).drop("_done")
