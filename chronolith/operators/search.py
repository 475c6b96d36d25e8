"""Keyword, semantic and fused search over extracted content."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.text import keyword_form
from ..functions.values import clamp_limit, dot
from ..session import few, sliced
from .intervals import outside

RRF_CONSTANT = 60


def bounded(frames: DataFrame, start=None, end=None, app: str | None = None, text: str | None = "extracted_text") -> DataFrame:
    """Frames with a text, in the bounds (both included) and app asked for: all of it reaches the scan."""
    out = frames if text is None else frames.filter(F.col(text) != "")
    if start is not None:
        out = out.filter(F.col("frame_timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("frame_timestamp") <= F.lit(end).cast("timestamp"))
    if app is not None:
        out = out.filter(F.col("app_name") == app)
    return out


def matching(frames: DataFrame, query: str, start=None, end=None, app: str | None = None, text: str = "extracted_text", normalised: bool = False) -> DataFrame:
    """The bounded frames whose text holds the query, in any case and composition of its characters."""
    needle = F.lit(unicodedata.normalize("NFC", query).lower())
    return bounded(frames, start, end, app, text).filter(F.contains(keyword_form(F.col(text), normalised), needle))


def newest(frames: DataFrame, limit: float | None = None, after: tuple | None = None) -> DataFrame:
    """The newest frames, ties by id; `after` (timestamp, id) is the cursor of the page before."""
    if after is not None:
        ts, frame = after
        at = F.lit(ts).cast("timestamp")
        frames = frames.filter((F.col("frame_timestamp") < at) | ((F.col("frame_timestamp") == at) & (F.col("frame_id") < frame)))
    return frames.orderBy(F.desc("frame_timestamp"), F.desc("frame_id")).limit(clamp_limit(limit))


def within_budget(frames: DataFrame, budget: int) -> tuple[DataFrame, bool]:
    """The newest `budget` frames, which a budgeted scan looks at, and whether there are more.

    The time and id of the last one are found on times and ids alone; what is older is filtered in the scan.
    """
    if few(frames.select("frame_id"), budget):
        return frames, False
    order = [F.desc("frame_timestamp"), F.desc("frame_id")]
    placed = sliced(frames.select("frame_timestamp", "frame_id"), order, "scan")
    left = budget
    for r in placed.groupBy("_part").count().orderBy("_part").collect():  # a row a slice
        if r["count"] >= left:
            last = placed.filter(F.col("_part") == r["_part"]).orderBy(*order).limit(left).agg(F.min(F.struct("frame_timestamp", "frame_id")).alias("m")).first()["m"]
            break
        left -= r["count"]
    at = F.lit(last["frame_timestamp"])
    return frames.filter((F.col("frame_timestamp") > at) | ((F.col("frame_timestamp") == at) & (F.col("frame_id") >= last["frame_id"]))), True


def scan_state(frames: DataFrame, budget: int) -> DataFrame:
    """How many frames there are, how many a budget scans, and whether it stops short."""
    n = F.count("*")
    return frames.agg(n.alias("eligible"), F.least(n, F.lit(budget)).cast("long").alias("scanned"), (n > budget).alias("truncated"))


def held(hits: DataFrame) -> DataFrame:
    """Hits, which a result limit (100 rows at most) has made few, as a local table: what they were searched in is scanned once, however often they are used."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def of_keys(rows: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur among hits (held): the keys reach the scan of rows as values."""
    out = rows
    for k in keys:
        out = out.filter(F.col(k).isin([r[0] for r in hits.select(k).distinct().collect() if r[0] is not None]))
    return out


def with_sessions(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Hits with the session that owns them, if any. Owners are cut down to the hits before they meet."""
    own = owners.join(F.broadcast(hits.select("frame_id").distinct()), "frame_id", "left_semi")  # hits are limited
    return hits.join(own, "frame_id", "left")


def grouped_by_session(hits: DataFrame) -> DataFrame:
    """Owned hits by session: groups in the order of their first hit, hits in their order (rank)."""
    groups = hits.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        F.min("rank").alias("first_rank"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "frame_id"))), lambda x: x["frame_id"]).alias("frame_ids")
    )
    return groups.orderBy("first_rank")


def without_suppressed_points(hits: DataFrame, ranges: DataFrame, ts: str = "frame_timestamp") -> DataFrame:
    """Drop rows whose time falls into a (from, to) range, ends included; rows without a time stay."""
    return outside(hits, ranges, ts)


def similarity(embedding: Column, query: list[float]) -> Column:
    return F.round(dot(embedding, F.array(*[F.lit(float(x)) for x in query])), 6)


def nearest(vectors: DataFrame, query: list[float], limit: int = 10, offset: int = 0) -> DataFrame:
    """The vectors with the largest dot product: (id, score) and the rest, ties by id. Filters belong before it: they reach the scan."""
    scored = vectors.filter(F.size("embedding") > 0).withColumn("score", similarity(F.col("embedding"), query)).drop("embedding")
    ordered = scored.orderBy(F.desc("score"), F.asc("id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def resolved(hits: DataFrame, frames: DataFrame, limit: int) -> DataFrame:
    """Vector hits whose id names a frame that exists (`extracted:<frame id>`), best first."""
    named = hits.withColumn("frame_id", F.nullif(F.regexp_extract("id", r"^extracted:(-?\d+)$", 1), F.lit("")).try_cast("bigint"))
    return frames.join(F.broadcast(named.filter("frame_id IS NOT NULL")), "frame_id").orderBy(F.desc("score"), F.asc("frame_id")).limit(limit)


def fused(keyword: DataFrame, semantic: DataFrame, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (id, rank from 0): id, score, source."""
    part = lambda c: F.coalesce(1.0 / (RRF_CONSTANT + F.col(c) + 1), F.lit(0.0))
    both = keyword.select("id", F.col("rank").alias("k")).join(semantic.select("id", F.col("rank").alias("s")), "id", "full")
    source = F.when(F.col("k").isNotNull() & F.col("s").isNotNull(), "hybrid").when(F.col("k").isNotNull(), "keyword").otherwise("semantic")
    return both.select("id", F.round(part("k") + part("s"), 6).alias("score"), source.alias("source")).orderBy(F.desc("score"), F.asc("id")).limit(limit)


def ranks(hits: DataFrame, *order: Column) -> DataFrame:
    """A rank from 0 over hits, which a limit has made few."""
    return hits.withColumn("rank", (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
