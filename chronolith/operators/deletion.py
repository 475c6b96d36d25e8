"""Deletion as a whole: frames with their elements, what is derived from them, counts of both, and tombstones for what failed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import materialize
from .lifecycle import content_without_frames, retention_cut, sessions_without_frames, vectors_without_frames
from .privacy import tombstone, unresolved


@dataclass
class Deleted:
    """Tables that remain, written, and how many rows each has lost."""

    tables: dict[str, DataFrame]
    counts: dict[str, int]


def rewritten(table: DataFrame, left: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, int]:
    """(what left keeps of table, written; how many rows went). Both counts ride on the one pass that writes: rows are counted where they are read and where they are written."""
    before, after = Observation(), Observation()
    out = materialize(left(table.observe(before, F.count(F.lit(1)).alias("n"))).observe(after, F.count(F.lit(1)).alias("n")), name)
    return out, before.get["n"] - after.get["n"]


def frames_deleted(frames: DataFrame, elements: DataFrame, ids: DataFrame) -> Deleted:
    """Frames of ids (frame_id) and their elements go. A frame that refers to the elements of one that goes keeps nothing of them."""
    own, n = rewritten(frames, lambda t: t.join(ids, "frame_id", "left_anti"), "frames")
    parts, m = rewritten(elements, lambda t: t.join(ids, "frame_id", "left_anti"), "elements")
    return Deleted({"frames": own, "elements": parts}, {"frames": n, "elements": m})


def derived_deleted(sessions: DataFrame, content: DataFrame, vectors: DataFrame, ids: DataFrame) -> Deleted:
    """What is derived from frames of ids goes: their content and vectors, and sessions that hold any of them as evidence."""
    rules = {"sessions": (sessions, sessions_without_frames), "content": (content, content_without_frames), "vectors": (vectors, vectors_without_frames)}
    made = {name: rewritten(t, lambda x, rule=rule: rule(x, ids), name) for name, (t, rule) in rules.items()}
    return Deleted({k: v[0] for k, v in made.items()}, {k: v[1] for k, v in made.items()})


def _noted(frames: DataFrame, ids: DataFrame, now, tombstones: DataFrame) -> DataFrame:
    """tombstones with one more: the range of the frames of ids, and their ids. One row: its ids are those of one deletion."""
    gone = frames.join(ids, "frame_id", "left_semi").agg(F.min("frame_timestamp").alias("_from"), F.max("frame_timestamp").alias("_to"), F.sort_array(F.collect_list(F.col("frame_id").cast("long"))).alias("_ids"))
    made = gone.select(tombstone(F.col("_from"), F.col("_to"), F.col("_ids"), F.lit(now).cast("timestamp")).alias("t")).select("t.*").withColumn("id", F.xxhash64("from", "to", "created_at"))
    return tombstones.unionByName(made.select(tombstones.columns))


TOMBSTONE = "id long, `from` timestamp, `to` timestamp, reason string, failed_frame_ids array<long>, created_at timestamp, resolved_at timestamp"


def cascaded(frames: DataFrame, elements: DataFrame, ids: DataFrame, derived: Callable[[DataFrame], Deleted], now, tombstones: DataFrame) -> tuple[Deleted, DataFrame, str | None]:
    """(what remains, tombstones, why the cascade failed): frames and elements of ids go, then what `derived` deletes of ids.

    Frames are never brought back. If the cascade fails, a tombstone hides its range from results until it is tried again (`reconciled`).
    """
    ids = materialize(ids.select("frame_id").distinct(), "deleted-ids")
    upstream = frames_deleted(frames, elements, ids)
    try:
        rest = derived(ids)
    except Exception as e:  # noqa: BLE001  whatever failed, its rows are hidden from now on
        return upstream, materialize(_noted(frames, ids, now, tombstones), "tombstones"), f"Cascade_Delete failed: {e}"
    return Deleted(upstream.tables | rest.tables, upstream.counts | rest.counts), tombstones, None


def reconciled(tombstones: DataFrame, derived: Callable[[DataFrame], Deleted], now) -> tuple[DataFrame, int]:
    """(tombstones, how many are resolved now): each unresolved one is tried again, by the ids of its frames, oldest first. One that fails again stays as it is.

    Tombstones are as many as deletions have failed: their keys alone come to the driver.
    """
    spark, done = tombstones.sparkSession, []
    for row in unresolved(tombstones).orderBy("created_at", "id").select("id").collect():
        ids = tombstones.filter(F.col("id") == row["id"]).select(F.explode("failed_frame_ids").alias("frame_id"))
        try:
            derived(ids)
        except Exception:  # noqa: BLE001, S112  the next reconciliation tries it again
            continue
        done.append((row["id"],))
    hit = spark.createDataFrame(done, "id long").withColumn("_now", F.lit(now).cast("timestamp"))
    out = tombstones.join(hit, "id", "left").withColumn("resolved_at", F.coalesce("resolved_at", "_now")).select(tombstones.columns)
    return materialize(out, "tombstones"), len(done)


def retained(frames: DataFrame, elements: DataFrame, budget: int, floor, derived: Callable[[DataFrame], Deleted], now, tombstones: DataFrame, size: str = "bytes", batch: int = 100) -> tuple[Deleted, DataFrame, bool]:
    """(what remains, tombstones, whether the floor was reached): the oldest frames go, in whole batches, until live bytes fit the budget; none from `floor` on. What is derived from them goes too.

    The floor is reached if what is left is still over the budget.
    """
    ids = retention_cut(frames, budget, floor, size, batch)
    left, noted, _ = cascaded(frames, elements, ids, derived, now, tombstones)
    over = left.tables["frames"].agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"] > budget
    return left, noted, over
