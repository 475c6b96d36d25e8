"""Deletion, retention and secure pruning: each returns the tables that remain."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.text import frame_of_capture
from ..functions.values import iso
from ..session import intermediate_dir, materialize, sliced


def sessions_without_frames(sessions: DataFrame, ids: DataFrame, frame: str = "frame_id") -> DataFrame:
    """Drop each session of which any evidence frame is among ids (frame_id)."""
    hit = sessions.select("session_id", F.explode("evidence_frame_ids").alias(frame)).join(ids, frame, "left_semi").select("session_id")
    return sessions.join(hit, "session_id", "left_anti")


def content_without_frames(content: DataFrame, ids: DataFrame, frame: str = "frame_id") -> DataFrame:
    return content.join(ids, frame, "left_anti")


def vectors_without_frames(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop vectors (id, meta_frame_id, capture_id) of frames: by id `extracted:N`; others by their metadata or by the frame of their capture."""
    own = F.nullif(F.regexp_extract("id", r"^extracted:(-?\d+)$", 1), F.lit("")).try_cast("bigint")
    legacy = F.array(F.col("meta_frame_id"), frame_of_capture(F.col("capture_id")))
    keys = F.when(F.col("id").startswith("extracted:"), F.array(own)).otherwise(legacy)
    hit = vectors.select("id", F.explode(keys).alias("frame_id")).join(ids, "frame_id", "left_semi").select("id")
    return vectors.join(hit, "id", "left_anti")


def vectors_outside(vectors: DataFrame, start, end) -> DataFrame:
    """Drop vectors whose frame time, or else own time, is in the range, ends included."""
    at = F.coalesce(F.try_to_timestamp(F.nullif(F.col("frame_timestamp"), F.lit(""))), F.col("timestamp"))
    return vectors.filter(at.isNull() | ~at.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def cascade(sessions: DataFrame, content: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return sessions_without_frames(sessions, ids), content_without_frames(content, ids), vectors_without_frames(vectors, ids)


def cascade_range(sessions: DataFrame, content: DataFrame, vectors: DataFrame, frames: DataFrame, start, end) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What remains once all that belongs to frames of a range, and vectors of that time, have gone."""
    left = cascade(sessions, content, vectors, frames_in_range(frames, start, end))
    return left[0], left[1], vectors_outside(left[2], start, end)


def without_trees(frames: DataFrame, elements: DataFrame, before) -> DataFrame:
    """frames older than a time lose their tree where its elements are stored: under the frame they refer to, or their own."""
    held = elements.select(F.col("frame_id").alias("_held"), F.lit(True).alias("_has")).distinct()
    own = F.coalesce("elements_ref_frame_id", "frame_id") if "elements_ref_frame_id" in frames.columns else F.col("frame_id")
    swept = (F.col("frame_timestamp") < F.lit(before).cast("timestamp")) & F.coalesce("_has", F.lit(False))
    out = frames.join(held, own == F.col("_held"), "left").withColumn("accessibility_tree_json", F.when(~swept, F.col("accessibility_tree_json")))
    return out.select(frames.columns)


def migrated(table: DataFrame, times: list[str]) -> DataFrame:
    """A table whose times, given as text, are all in UTC with a Z; what is no time stays as it is."""
    utc = lambda c: F.when(F.col(c).endswith("Z"), F.col(c)).otherwise(F.coalesce(iso(F.try_to_timestamp(c)), F.col(c)))
    return table.withColumns({c: utc(c) for c in times})


def frames_in_range(frames: DataFrame, start, end) -> DataFrame:
    """Ids of frames in the range by whole seconds, ends included."""
    at = F.date_trunc("second", "frame_timestamp")
    low, high = (F.date_trunc("second", F.lit(x).cast("timestamp")) for x in (start, end))
    return frames.filter(at.between(low, high)).select("frame_id")


def retention_cut(frames: DataFrame, budget: Column | int, floor, size: str = "bytes", batch: int = 100) -> DataFrame:
    """Ids of the frames to delete: the oldest, in whole batches, until live bytes fit the budget (a number, or a column over `total`); none from `floor` on.

    Running sums go over slices of the table in order of time, then over the slices (a row each): no task orders all frames.
    """
    placed = sliced(frames.select("frame_id", "frame_timestamp", F.col(size).alias("_size")), [F.col("frame_timestamp"), F.col("frame_id")], "retention")
    slices = placed.groupBy("_part").agg(F.sum("_size").alias("_b"), F.count("*").alias("_n"))
    past = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    slices = slices.select("_part", F.coalesce(F.sum("_b").over(past), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n0"), F.sum("_b").over(whole).alias("total"))
    within = W.partitionBy("_part").orderBy("frame_timestamp", "frame_id")
    placed = placed.join(F.broadcast(slices), "_part")  # a row a shuffle partition
    placed = placed.withColumn("_before", F.col("_b0") + F.coalesce(F.sum("_size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("_batch", F.floor((F.col("_n0") + F.row_number().over(within) - 1) / batch))
    # a batch goes if the frames before it don't free enough
    freed = placed.groupBy("_batch").agg(F.min("_before").alias("_freed"))
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    return placed.join(freed, "_batch").filter((F.col("total") - F.col("_freed") > limit) & (F.col("frame_timestamp") < F.lit(floor).cast("timestamp"))).select("frame_id")


def secure_subtrees(nodes: DataFrame, secure_roles: list[str]) -> DataFrame:
    """nodes (frame_id, id, role, parent_id, path) without secure nodes and all below them; parent_id or path may be missing.

    A frame whose nodes have a parent_id is walked along it, a level a round, each round joining the last one's nodes only; a node
    met before isn't met again, so cycles end. A frame with none but with dotted paths loses what lies below a secure path. A frame with
    neither loses its secure nodes only. Nodes without a frame are each their own.
    """
    for c, kind in (("parent_id", nodes.schema["id"].dataType), ("path", "string")):
        nodes = nodes if c in nodes.columns else nodes.withColumn(c, F.lit(None).cast(kind))
    secure = F.coalesce(F.lower("role").isin([r.lower() for r in secure_roles]), F.lit(False))
    tree = materialize(nodes.filter("frame_id IS NOT NULL").select("frame_id", "id", "parent_id", "path", secure.alias("secure")), "tree")
    shape = tree.groupBy("frame_id").agg(F.max("secure").alias("secure"), (F.count("parent_id") > 0).alias("linked"), (F.count("path") > 0).alias("placed"))
    shape = shape.filter("secure").select("frame_id", "linked", "placed")
    tree = materialize(tree.join(shape, "frame_id"), "secure-trees")

    spark, path = nodes.sparkSession, f"{intermediate_dir(nodes.sparkSession)}/blocked-{uuid.uuid4().hex}"
    found = tree.filter("secure AND (linked OR placed)").select("frame_id", "id").distinct()
    children = tree.filter("linked AND parent_id IS NOT NULL").select("frame_id", "id", "parent_id")
    for level in itertools.count():
        found.write.parquet(f"{path}/level={level}")  # each level is written once
        frontier, blocked = (spark.read.schema(found.schema).parquet(x).select("frame_id", "id") for x in (f"{path}/level={level}", path))
        if frontier.isEmpty():
            break
        below = children.join(frontier.withColumnRenamed("id", "parent_id"), ["frame_id", "parent_id"], "left_semi").select("frame_id", "id").distinct()
        found = below.join(blocked, ["frame_id", "id"], "left_anti")

    # paths: a node goes if any of the paths above its own belongs to a secure node
    paths = tree.filter("placed AND NOT linked AND path IS NOT NULL")
    parts = F.split("path", r"\.")
    above = paths.select("frame_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("path"))
    by_path = above.join(paths.filter("secure").select("frame_id", "path").distinct(), ["frame_id", "path"], "left_semi").select("frame_id", "id")
    kept = nodes.join(blocked.unionByName(by_path).distinct(), ["frame_id", "id"], "left_anti")  # a null frame_id meets nothing
    return kept.filter(~secure).select(nodes.columns)


def compacted(df: DataFrame, path: str, files: int) -> None:
    """Rewrite a table into so many files."""
    df.repartition(files).write.mode("overwrite").parquet(path)
