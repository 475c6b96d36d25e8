"""Ingestion: merging sources, privacy, checkpoints, embeddings by hash."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.values import seconds_between


def merged_sources(accessibility: DataFrame, ocr: DataFrame) -> DataFrame:
    """One record a frame (or id, where the frame is missing) from (id, frame_id, ts, text, seq): accessibility wins over OCR;
    within accessibility the last record wins, within OCR the first."""
    both = accessibility.withColumn("source", F.lit("accessibility")).withColumn("_o", -F.col("seq")).unionByName(
        ocr.withColumn("source", F.lit("ocr")).withColumn("_o", F.col("seq"))
    )
    key = F.coalesce(F.concat(F.lit("frame:"), F.col("frame_id").cast("string")), F.concat(F.lit("id:"), F.col("id")))
    best = W.partitionBy("_k").orderBy("source", "_o", "id")
    return both.withColumn("_k", key).withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_k", "_r", "_o")


def capture_page(accessibility: DataFrame | None, ocr: DataFrame | None, start=None, end=None, app: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, bool]:
    """A page of merged captures in order of time, and whether one of the two sources was missing. Bounds (both included) and app reach both scans."""
    if accessibility is None and ocr is None:
        raise ValueError("neither source of captures can be read")

    def of(side: DataFrame) -> DataFrame:
        side = side if start is None else side.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
        side = side if end is None else side.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
        return side if app is None else side.filter(F.col("app_name") == app)

    sides = [of(x) if x is not None else None for x in (accessibility, ocr)]
    sides = [x if x is not None else next(y for y in sides if y is not None).filter(F.lit(False)) for x in sides]
    return in_record_order(merged_sources(*sides), "ts").offset(offset).limit(limit), accessibility is None or ocr is None


def in_record_order(records: DataFrame, ts: str = "timestamp", key: str = "id") -> DataFrame:
    """Records by time, then id; times that can't be read come last, by their text."""
    at = F.col(ts) if records.schema[ts].dataType.simpleString() == "timestamp" else F.try_to_timestamp(F.col(ts))
    return records.orderBy(F.asc_nulls_last(at), F.col(ts).cast("string"), F.col(key))


def normalised_records(raw: DataFrame, page_offset: int = 0) -> DataFrame:
    """Records with a time and a text or a usable tree; ids that are missing are made from frame and place."""
    usable = F.col("accessibility_tree_json").rlike(r'(?s)^\s*[\[{].*"(role|text|value|title|description)"')
    made = F.concat_ws(":", F.lit("frame"), F.col("frame_id").cast("string"), (F.col("seq") + page_offset).cast("string"))
    kept = raw.filter(F.col("timestamp").isNotNull() & ((F.trim(F.coalesce("text", F.lit(""))) != "") | F.coalesce(usable, F.lit(False))))
    return kept.withColumn("id", F.coalesce("id", made))


def without_excluded_apps(frames: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop frames of excluded apps (app), whatever their case; frames without an app stay. The planner sends the list around while it is small."""
    return frames.join(excluded.select(F.lower("app").alias("_app")).distinct(), F.lower("app_name") == F.col("_app"), "left_anti")


def outside_pause(frames: DataFrame, paused: bool, since) -> DataFrame:
    return frames if not paused or since is None else frames.filter(F.col("frame_timestamp") < F.lit(since).cast("timestamp"))


def newer_than(frames: DataFrame, ts, frame: int, resumed: bool = False) -> DataFrame:
    """Frames after a checkpoint in the order of (timestamp, id); of the next pages of a backlog, whose order is the provider's, all but the checkpoint's own frame."""
    at = F.lit(ts).cast("timestamp")
    if resumed:
        return frames.filter((F.col("frame_timestamp") != at) | (F.col("frame_id") != frame))
    return frames.filter((F.col("frame_timestamp") > at) | ((F.col("frame_timestamp") == at) & (F.col("frame_id") > frame)))


def checkpoint(results: DataFrame) -> DataFrame:
    """From (frame_timestamp, frame_id, failed): the earliest failed frame, and the last good one before it, which becomes the checkpoint."""
    place = F.struct("frame_timestamp", "frame_id")
    ceiling = results.agg(F.min(F.when(F.col("failed"), place)).alias("ceiling"))
    below = results.crossJoin(F.broadcast(ceiling))  # one row
    good = ~F.col("failed") & (F.col("ceiling").isNull() | (place < F.col("ceiling")))
    out = below.agg(F.first("ceiling").alias("c"), F.max(F.when(good, place)).alias("k"))
    return out.select(
        F.col("c.frame_timestamp").alias("ceiling_ts"), F.col("c.frame_id").alias("ceiling_id"), F.col("k.frame_timestamp").alias("checkpoint_ts"), F.col("k.frame_id").alias("checkpoint_id")
    )


def committed(results: DataFrame, context: str = "context_key") -> DataFrame:
    """results (frame_timestamp, frame_id, context, failed, extracted_text) with `committed`: whether a result becomes state.

    Results from the first failure on don't, as the checkpoint stops there; nor do those of a context after a failed frame of it that has a text.
    """
    place = F.struct("frame_timestamp", "frame_id")
    ceiling = results.filter("failed").agg(F.min(place).alias("_ceiling"))  # one row
    blocked = results.filter("failed AND extracted_text <> ''").groupBy(context).agg(F.min(place).alias("_blocked"))
    out = results.crossJoin(F.broadcast(ceiling)).join(blocked, context, "left")
    before = lambda c: F.col(c).isNull() | (place < F.col(c))
    return out.withColumn("committed", ~F.col("failed") & before("_ceiling") & before("_blocked")).drop("_ceiling", "_blocked")


def hydrated(rows: DataFrame, open_sessions: DataFrame, checkpoint, context: str = "context_key") -> DataFrame:
    """The rows that line state is rebuilt from: those of contexts with an open session (started_at), from its start to the checkpoint."""
    since = open_sessions.groupBy(context).agg(F.min("started_at").alias("_since"))
    return rows.join(since, context).filter((F.col("frame_timestamp") >= F.col("_since")) & (F.col("frame_timestamp") <= F.lit(checkpoint).cast("timestamp"))).drop("_since")


def freshness(lag_minutes: Column, backlog: Column, window: int = 15) -> Column:
    whole = F.floor(lag_minutes)
    return (
        F.when(lag_minutes.isNull(), "stale-beyond-window")
        .when(backlog, "catching-up")
        .when(whole <= window, "fresh")
        .when(whole <= 2 * window, "catching-up")
        .otherwise("stale-beyond-window")
    )


def fetch_window(lag_minutes: float | None, window: int = 15, batches: int = 3) -> tuple[int, bool]:
    """(minutes to fetch, backlog needed): the lag rounded up, from one window to one for each batch of a run; a backlog if there is no checkpoint or it is older."""
    if lag_minutes is None:
        return window * batches, True
    wanted = min(max(math.ceil(lag_minutes), window), window * batches)
    return wanted, lag_minutes > wanted


def with_cached_embeddings(frames: DataFrame, cache: DataFrame) -> DataFrame:
    """frames (text_hash) with embedding from cache (hash, embedding), null for a miss."""
    return frames.join(cache.withColumnRenamed("hash", "text_hash"), "text_hash", "left")


def embedded(frames: DataFrame, cache: DataFrame, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(frames with embeddings, rows to add to the cache): each distinct text that the cache lacks is embedded once."""
    missing = frames.join(cache.select(F.col("hash").alias("text_hash")), "text_hash", "left_anti").dropDuplicates(["text_hash"])
    new = missing.select(F.col("text_hash").alias("hash"), embed(F.col("extracted_text")).alias("embedding"))
    return with_cached_embeddings(frames, cache.select("hash", "embedding").unionByName(new)), new


def inserted_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and those rows whose key it lacks, the first of each key by all columns."""
    fresh = rows.join(table.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_v"))
    return table.unionByName(fresh.select(key, "_v.*"))


def upserted(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """table with rows replacing those of equal key; of several rows of a key the last by order."""
    value = F.struct(*[F.col(c) for c in rows.columns if c != key])
    last = rows.groupBy(key).agg(F.max_by(value, order).alias("_v")).select(key, "_v.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def with_embedding(rows: DataFrame) -> DataFrame:
    """Rows that have an embedding: others are never put into a vector table."""
    return rows.filter(F.coalesce(F.size("embedding") > 0, F.lit(False)))


def source_types(metadata: Column, own: Column) -> Column:
    """The sources of a record: those in its metadata (JSON) if there are any, else its own, else none."""
    return F.coalesce(F.from_json(F.get_json_object(metadata, "$.sourceTypes"), "array<string>"), own, F.array().cast("array<string>"))


def reset(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.filter(F.lit(False))


def last_extracted(frames: DataFrame, text: str = "extracted_text") -> DataFrame:
    """The time of the newest frame with a text."""
    return frames.agg(F.max(F.when(F.col(text) != "", F.col("frame_timestamp"))).alias("last_extracted"))


def is_ready(last: Column, wanted: Column) -> Column:
    """Whether what is asked for has been extracted: the newest text is not older than the end of the record."""
    return F.coalesce(last >= wanted, F.lit(False))


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the non-null columns of changes (one row a key) put in."""
    changed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    named = set(changes.columns) - {key}
    return table.join(changed, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in named else c for c in table.columns])


def stage_lag(frames: DataFrame, now: Column) -> DataFrame:
    return frames.agg((seconds_between(now, F.max("frame_timestamp")) / 60).alias("lag_minutes"))
