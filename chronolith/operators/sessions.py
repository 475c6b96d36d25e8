"""Gap sessions, recall by session, hour or day, and inspection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import narratives
from ..functions.values import bucket_start, clamp, half_up, seconds_between
from .intervals import outside

IDLE_SECONDS = 120


def sessionized(frames: DataFrame, keys: list[str], idle: int = IDLE_SECONDS, ts: str = "frame_timestamp", frame: str = "frame_id") -> DataFrame:
    """frames with session_no (from 0 within its key), session_id and gap_seconds to the frame before (null for a first frame).

    A frame extends its session if it comes at most `idle` seconds after the last; event time decides, as frames are ordered by it.
    Rows are shuffled and ordered by key and day, so that a key with a large share of all rows spreads over its days; what crosses midnight is
    settled on a table of a row a key and day.
    """
    running = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    by_day = W.partitionBy(*keys, "_day").orderBy(ts, frame)
    gap = seconds_between(F.col(ts), F.lag(ts).over(by_day))
    rows = frames.withColumn("_day", F.date_trunc("day", ts)).withColumns({"_gap": gap, "_at": F.row_number().over(by_day)})
    rows = rows.withColumn("_new", F.when(F.col("_gap") <= idle, 0).otherwise(1)).withColumn("_opened", F.sum("_new").over(running(by_day)))

    days = rows.groupBy(*keys, "_day").agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), (F.sum("_new") - 1).alias("_inside"))
    by_key = W.partitionBy(*keys).orderBy("_day")
    days = days.withColumn("_night", seconds_between(F.col("_from"), F.lag("_to").over(by_key))).withColumn("_first", F.when(F.col("_night") <= idle, 0).otherwise(1))
    days = days.withColumn("_past", F.sum(F.col("_inside") + F.col("_first")).over(running(by_key)) - F.col("_inside"))  # sessions up to the day's first frame
    side = days.select(*[F.col(k).alias(f"_{k}_") for k in keys], F.col("_day").alias("_day_"), "_night", "_past")
    met = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"{x}_" if x == "_day" else f"_{x}_")) for x in [*keys, "_day"]])
    own = F.when(F.col("_at") == 1, F.col("_night")).otherwise(F.col("_gap"))
    numbered = rows.join(side, met).withColumn("gap_seconds", F.when(own <= idle, own)).withColumn("session_no", (F.col("_past") + F.col("_opened") - 2).cast("long"))
    name = F.concat_ws("#", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col("session_no").cast("string"))
    return numbered.select(*frames.columns, "gap_seconds", "session_no", name.alias("session_id"))


def sessions_of(numbered: DataFrame, keys: list[str], ts: str = "frame_timestamp", frame: str = "frame_id", first: tuple[str, ...] = ()) -> DataFrame:
    """One row a session: its bounds, active seconds (a first frame adds none), its frames in order of time, and what its first frame says (app, label, source types)."""
    return numbered.groupBy(*keys, "session_id").agg(
        *[F.min_by(c, F.struct(F.col(ts), F.col(frame))).alias(c) for c in first],
        F.min(ts).alias("started_at"),
        F.max(ts).alias("ended_at"),
        F.coalesce(F.sum("gap_seconds"), F.lit(0.0)).alias("active_seconds"),
        F.count("*").alias("frames"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(ts), F.col(frame)))), lambda x: x[frame]).alias("evidence_frame_ids"),
    )


def idle_flushed(sessions: DataFrame, now: Column, idle: int = IDLE_SECONDS) -> DataFrame:
    """Sessions with is_open and closed_at: closed if the last frame is over `idle` seconds old (strictly)."""
    closed = F.col("ended_at") < now - F.make_interval(secs=F.lit(idle))
    return sessions.withColumn("is_open", ~closed).withColumn("closed_at", F.when(closed, now))


def open_session_for(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """The open session of each key that ended last."""
    row = F.struct(*[F.col(c) for c in sessions.columns])
    return sessions.filter("is_open").groupBy(*keys).agg(F.max_by(row, F.struct("ended_at", "session_id")).alias("_s")).select("_s.*")


def session_list(sessions: DataFrame, start=None, end=None, app: str | None = None, is_open: bool | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sessions that started within the bounds, newest first."""
    out = sessions
    if start is not None:
        out = out.filter(F.col("started_at") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("started_at") <= F.lit(end))
    if app is not None:
        out = out.filter(F.col("app_name") == app)
    if is_open is not None:
        out = out.filter(F.col("is_open") == is_open)
    out = out.orderBy(F.desc("started_at"), F.asc("session_id"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def without_suppressed_intervals(sessions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Drop sessions that overlap any (from, to) range, both ends included."""
    return outside(sessions, ranges, "started_at", "ended_at")


def recall_sessions(sessions: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Sessions for display: whole seconds, `unknown` for a missing app."""
    kept = sessions if suppressed is None else without_suppressed_intervals(sessions, suppressed)
    return kept.withColumn("active_seconds", half_up(F.col("active_seconds")).cast("long"))


def frame_slices(numbered: DataFrame, idle: int = IDLE_SECONDS, ts: str = "frame_timestamp", frame: str = "frame_id") -> DataFrame:
    """The seconds each frame stands for: until the next of its session, a second for the last."""
    following = F.lead(ts).over(W.partitionBy("session_id").orderBy(ts, frame))
    seconds = F.when(following.isNull(), F.lit(1.0)).otherwise(F.floor(clamp(seconds_between(following, F.col(ts)), 0, idle)).cast("double"))
    return numbered.withColumn("slice_seconds", seconds)


def recall_blocks(numbered: DataFrame, granularity: str, idle: int = IDLE_SECONDS, app: str = "app_name", ts: str = "frame_timestamp", frame: str = "frame_id") -> DataFrame:
    """Per UTC hour or day and app: sessions that touch it and seconds. `recall_totals` sums apps up."""
    sliced = frame_slices(numbered, idle, ts, frame).withColumn("bucket_start", bucket_start(F.col(ts), granularity))
    return sliced.groupBy("bucket_start", F.coalesce(app, F.lit("unknown")).alias("app_name")).agg(
        F.countDistinct("session_id").alias("sessions"), F.sum("slice_seconds").cast("long").alias("seconds")
    )


def recall_totals(numbered: DataFrame, granularity: str, idle: int = IDLE_SECONDS, ts: str = "frame_timestamp", frame: str = "frame_id") -> DataFrame:
    sliced = frame_slices(numbered, idle, ts, frame).withColumn("bucket_start", bucket_start(F.col(ts), granularity))
    return sliced.groupBy("bucket_start").agg(F.countDistinct("session_id").alias("sessions"), F.sum("slice_seconds").cast("long").alias("seconds"))


def recall_by_app(blocks: DataFrame) -> DataFrame:
    """Blocks with their apps as one map."""
    pair = F.sort_array(F.collect_list(F.struct("app_name", "seconds")))
    return blocks.groupBy("bucket_start").agg(F.sum("seconds").alias("seconds"), F.map_from_entries(pair).alias("by_app"))


def missing_evidence_seconds(sessions: DataFrame, frames: DataFrame, granularity: str, frame: str = "frame_id") -> DataFrame:
    """Evidence frames that are gone count one second each in the bucket where their session started."""
    ids = sessions.select("session_id", "started_at", F.explode("evidence_frame_ids").alias(frame))
    return ids.join(frames.select(frame), frame, "left_anti").groupBy(bucket_start(F.col("started_at"), granularity).alias("bucket_start")).agg(F.count("*").alias("seconds"))


def session_evidence(sessions: DataFrame, frames: DataFrame, session_ids: list[str], frame: str = "frame_id") -> DataFrame:
    """The frames of sessions in the order of their evidence lists; missing frames are skipped."""
    listed = sessions.filter(F.col("session_id").isin(session_ids)).select("session_id", F.posexplode("evidence_frame_ids").alias("position", frame))
    return listed.join(frames, frame)


def frame_owners(sessions: DataFrame, frame: str = "frame_id") -> DataFrame:
    """(frame, session_id): of several owners the one that started last."""
    ids = sessions.select("session_id", "started_at", F.explode("evidence_frame_ids").alias(frame))
    return ids.groupBy(frame).agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_id"))


def summary_text(sessions: DataFrame) -> DataFrame:
    """The template summary of each session (app_name, context_label): what is shown while no model has written one."""
    text = narratives.summary(*[F.col(c) for c in ("app_name", "context_label", "started_at", "ended_at", "active_seconds", "frames")])
    return sessions.withColumn("summary_text", text).withColumn("summary_status", F.lit("degraded"))


def counts(sessions: DataFrame, since) -> DataFrame:
    """One row: when a session was last closed, how many are open, started since a time, and summaries by status."""
    status = lambda *s: F.count_if(F.col("summary_status").isin(*s))
    return sessions.agg(
        F.max(F.when(~F.col("is_open"), F.col("ended_at"))).alias("last_closed"), F.count_if("is_open").alias("open"),
        F.count_if(F.col("started_at") >= F.lit(since).cast("timestamp")).alias("started_since"), status("ready").alias("ready"), status("pending").alias("pending"), status("failed", "degraded").alias("failed"),
    )
