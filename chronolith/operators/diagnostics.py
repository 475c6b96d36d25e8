"""Storage diagnostics and observability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.text import preview
from ..functions.values import ratio, seconds_between, slice_start

WINDOW_MINUTES, MIN_TEXT, GROUPS, SAMPLE, OCR_SAMPLE = 60, 24, 5, 1000, 5000


def duplication_sample(frames: DataFrame, text: str, since=None, sample: int = SAMPLE, min_text: int = MIN_TEXT) -> DataFrame:
    """The newest frames with a text long enough: what duplication is measured on (the sample is the feature)."""
    out = frames.filter(F.length(text) >= min_text)
    if since is not None:
        out = out.filter(F.col("frame_timestamp") >= F.lit(since).cast("timestamp"))
    return out.orderBy(F.desc("frame_timestamp"), F.desc("frame_id")).limit(sample)


def duplication_by_field(frames: DataFrame, fields: dict[str, int], since=None, min_text: int = MIN_TEXT) -> DataFrame:
    """The duplication summary of each text column (with the size of its sample): one row a column."""
    out = [duplication_summary(duplication_sample(frames, c, since, n, min_text), c).select(F.lit(c).alias("field"), "*") for c, n in fields.items()]
    return reduce(DataFrame.unionByName, out)


def duplication_summary(sample: DataFrame, text: str) -> DataFrame:
    return sample.agg(F.count("*").alias("total_rows"), F.countDistinct(text).alias("distinct_texts"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_chars"))


def duplicate_groups(sample: DataFrame, text: str, groups: int = GROUPS) -> DataFrame:
    found = sample.groupBy(text, "app_name", "window_name").agg(F.count("*").alias("occurrences"), F.max(F.length(text)).alias("text_chars")).filter("occurrences > 1")
    shown = found.withColumn("preview", preview(F.col(text)))
    return shown.orderBy(F.desc("occurrences"), F.desc("text_chars"), "app_name", "window_name", text).limit(groups).drop(text)


def redundancy(groups: DataFrame) -> DataFrame:
    """What the top groups repeat."""
    return groups.agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("duplicated_rows"),
        F.coalesce(F.sum((F.col("occurrences") - 1) * F.col("text_chars")), F.lit(0)).alias("redundant_chars"),
    )


def element_rows(elements: DataFrame, frames: DataFrame) -> DataFrame:
    """elements (frame_id, source, role, text) with the app and window of their frames, and bytes."""
    return elements.join(frames.select("frame_id", "app_name", "window_name", "frame_timestamp"), "frame_id").withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))))


def element_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total_rows"), F.countDistinct("app_name", "window_name", "source", "role").alias("distinct_keys"), F.sum("bytes").alias("total_bytes"))


def element_groups(rows: DataFrame, groups: int = GROUPS) -> DataFrame:
    found = rows.groupBy("app_name", "window_name", "source", "role").agg(F.count("*").alias("occurrences"), F.sum("bytes").alias("bytes"), F.max(preview(F.col("text"))).alias("preview")).filter("occurrences > 1")
    found = found.withColumn("redundant_bytes", F.floor(F.col("bytes") * (F.col("occurrences") - 1) / F.col("occurrences") + 0.5).cast("long"))
    return found.orderBy(F.desc("bytes"), F.desc("occurrences"), "app_name", "window_name", "source", "role").limit(groups)


def hotspot_fields(frames: DataFrame, columns: list[str], limit: int = GROUPS) -> DataFrame:
    """Bytes of text columns, largest first: one scan, unpivoted."""
    totals = frames.agg(*[F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias(c) for c in columns])
    return totals.unpivot([], columns, "field", "bytes").filter("bytes > 0").orderBy(F.desc("bytes"), "field").limit(limit)


def hotspot_apps(parts: list[DataFrame], limit: int = GROUPS) -> DataFrame:
    """Bytes by app over several tables of (app_name, bytes), each summed before they meet."""
    summed = [p.groupBy("app_name").agg(F.sum("bytes").alias("bytes")) for p in parts]
    return reduce(DataFrame.unionByName, summed).groupBy("app_name").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "app_name").limit(limit)


def hotspot_roles(rows: DataFrame, source: str = "accessibility", limit: int = GROUPS) -> DataFrame:
    return rows.filter(F.col("source") == source).groupBy("source", "role").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("elements")).orderBy(F.desc("bytes"), "role").limit(limit)


def growth_samples(frames: DataFrame, text: str, sample: int = SAMPLE, limit: int = 5) -> DataFrame:
    """The heaviest of the newest frames, unique ones before those whose text, app and window repeat."""
    newest = frames.filter(F.octet_length(text) > 0).orderBy(F.desc("frame_timestamp"), F.desc("frame_id")).limit(sample)
    n = F.count("*").over(W.partitionBy(text, "app_name", "window_name"))
    marked = newest.withColumn("bytes", F.octet_length(text)).withColumn("kind", F.when(n > 1, "duplicate-heavy").otherwise("unique-heavy"))
    return marked.select("frame_id", "app_name", "window_name", "bytes", "kind").orderBy(F.desc("kind"), F.desc("bytes"), F.desc("frame_id")).limit(limit)


def growth_slices(frames: DataFrame, text: str, minutes: int = 10, limit: int = 5) -> DataFrame:
    by = frames.withColumn("slice_start", slice_start(F.col("frame_timestamp"), minutes))
    out = by.groupBy("slice_start", "app_name", "window_name").agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("frames"))
    return out.orderBy(F.desc("bytes"), "slice_start", "app_name", "window_name").limit(limit)


def growth_summary(frames: DataFrame, text: str, sample: int = SAMPLE) -> DataFrame:
    newest = frames.orderBy(F.desc("frame_timestamp"), F.desc("frame_id")).limit(sample).withColumn("bytes", F.octet_length(text))
    return newest.filter("bytes > 0").agg(F.count("*").alias("frames"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def reuse_signal(frames: DataFrame, column: str, text: str, limit: int = GROUPS) -> DataFrame:
    """Value counts and bytes of a signal column, where the table has it."""
    if column not in frames.columns:
        raise ValueError(f"no column {column!r}")
    found = frames.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
    return found.agg(F.count("*").alias("matched_rows"), F.sum(F.octet_length(text)).alias("bytes")).orderBy(F.desc("matched_rows"), "value").limit(limit)


def reuse_summary(signals: DataFrame) -> DataFrame:
    """What the values shown match together."""
    return signals.agg(F.coalesce(F.sum("matched_rows"), F.lit(0)).alias("matched_rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def storage_report(frames: DataFrame, elements: DataFrame, fields: list[str], text: str = "extracted_text", since=None) -> dict[str, DataFrame]:
    """All tables of a deep storage report by name; each is its own lazy query over frames and elements (frame_id, source, role, text)."""
    rows = element_rows(elements, frames)
    sample = duplication_sample(frames, text, since)
    groups = duplicate_groups(sample, text)
    return {
        "duplication": duplication_by_field(frames, dict.fromkeys(fields, SAMPLE), since), "duplicate_groups": groups, "redundancy": redundancy(groups),
        "element_summary": element_summary(rows), "element_groups": element_groups(rows), "fields": hotspot_fields(frames, fields),
        "apps": hotspot_apps([rows, frames.withColumn("bytes", F.octet_length(text))]), "roles": hotspot_roles(rows),
        "growth_samples": growth_samples(frames, text), "growth_slices": growth_slices(frames, text), "growth": growth_summary(frames, text),
    }


def coverage(columns: list[str], optional: list[str]) -> str:
    """full, partial or unsupported, by how many of the optional columns a table has."""
    have = sum(c in columns for c in optional)
    return "full" if have == len(optional) else "partial" if have else "unsupported"


def byte_bucket(table: Column) -> Column:
    """frames, elements, fts or other, by the name of a table."""
    full_text = table.contains("_fts")
    named = lambda p: (table == p) | table.startswith(f"{p}_")
    return F.when(full_text, "fts").when(named("frames"), "frames").when(named("elements"), "elements").otherwise("other")


def byte_attribution(tables: DataFrame, total_bytes: int) -> DataFrame:
    """Bytes by bucket of (name, bytes), and what of the total no table accounts for."""
    known = tables.groupBy(byte_bucket(F.col("name")).alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("tables"))
    rest = tables.agg(F.greatest(F.lit(total_bytes) - F.coalesce(F.sum("bytes"), F.lit(0)), F.lit(0)).alias("bytes"))
    return known.unionByName(rest.select(F.lit("unattributed").alias("bucket"), "bytes", F.lit("").alias("tables")))


def artifact_ranking(artifacts: DataFrame) -> DataFrame:
    """Artifacts (key, bytes), largest first, with their share of all bytes."""
    total = artifacts.agg(F.sum("bytes").alias("_total"))
    return artifacts.crossJoin(F.broadcast(total)).select("key", "bytes", F.round(ratio(F.col("bytes").cast("double"), F.col("_total")), 6).alias("share")).orderBy(F.desc("bytes"), "key")


def ingestion_mix(vectors: DataFrame) -> DataFrame:
    """Records (source_types) from accessibility, which wins, and from OCR."""
    ax = F.array_contains("source_types", "accessibility")
    ocr = ~ax & F.array_contains("source_types", "ocr")
    out = vectors.agg(F.count_if(ax).alias("accessibility"), F.count_if(ocr).alias("ocr"))
    return out.withColumn("accessibility_ratio", F.round(ratio(F.col("accessibility").cast("double"), F.col("accessibility") + F.col("ocr")), 6))


def extraction_ratio(frames: DataFrame, text: str = "extracted_text") -> DataFrame:
    empty = F.count_if(F.coalesce(F.col(text), F.lit("")) == "")
    out = frames.agg(F.count("*").alias("total"), empty.alias("empty"))
    return out.withColumn("empty_ratio", F.round(ratio(F.col("empty").cast("double"), F.col("total")), 6))


def roll_up(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row on extraction, sessions (is_open) and summaries (summary_status)."""
    of = lambda *s: F.count_if(F.col("summary_status").isin(*s))
    told = sessions.agg(F.count("*").alias("sessions"), F.count_if("is_open").alias("open"), of("ready").alias("ready"), of("pending").alias("pending"), of("failed", "degraded").alias("failed"))
    return extraction_ratio(frames).crossJoin(told)  # a row each


def elided(columns: list[str]) -> Column:
    """The columns as a JSON object without those that are null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def capture_state(written: Column, running: Column, process_age: Column, frame_age: Column, grace: int = 60, liveness: int = 120) -> Column:
    return (
        F.when(~written & ~running, "process-down")
        .when(~written & (process_age > grace), "permissions-missing")
        .when(~written, "unknown")
        .when(~running, "process-down")
        .when(frame_age > liveness, "idle")
        .otherwise("ok")
    )


def disk_budget(size: Column, budget: Column) -> Column:
    return F.struct(F.greatest(budget - size, F.lit(0)).alias("headroom"), (size >= budget * 0.9).alias("warning"))


def recovery_status(readable: Column, persisted: Column, records: Column, checkpoint: Column, backlog: Column) -> Column:
    """What a vector store and its checkpoint (a time, null for none; backlog: one is under way) need: degraded where the store can't be read, needs-rebuild, or ready. An empty store that was never written is fine beside a checkpoint."""
    fresh = checkpoint.isNotNull() & ~persisted & F.coalesce(records == 0, F.lit(False))
    return F.when(~readable, "degraded").when(checkpoint.isNull() | backlog | (~persisted & ~fresh), "needs-rebuild").otherwise("ready")


def internal_status(frames: DataFrame, sessions: DataFrame, vectors: DataFrame | None, facts: DataFrame, budget: int, grace: int = 60, liveness: int = 120) -> DataFrame:
    """One row on everything: capture, sources, disk, retrieval, extraction, sessions and summaries.

    frames (frame_timestamp, extracted_text, bytes), sessions (is_open, summary_status), vectors (source_types), None where they can't be read, and facts, one row (now, running, process_age,
    persisted, checkpoint, backlog). A part whose table can't be read has nulls; the others are told all the same.
    """
    told = frames.agg(F.max("frame_timestamp").alias("last_frame"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"))
    mix = frames.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in (("records", "long"), ("accessibility", "long"), ("ocr", "long"), ("accessibility_ratio", "double"))])
    if vectors is not None:
        mix = ingestion_mix(vectors).crossJoin(vectors.agg(F.count("*").alias("records")))
    row = facts.crossJoin(told).crossJoin(mix).crossJoin(roll_up(frames, sessions))  # a row each
    age = seconds_between(F.col("now"), F.col("last_frame"))
    disk = disk_budget(F.col("size"), F.lit(budget))
    return row.select(
        capture_state(F.col("last_frame").isNotNull(), F.col("running"), F.col("process_age"), age, grace, liveness).alias("capture"),
        "accessibility", "ocr", "accessibility_ratio", disk["headroom"].cast("long").alias("headroom"), disk["warning"].alias("disk_warning"), F.col("checkpoint").isNotNull().alias("checkpoint_exists"),
        recovery_status(F.lit(vectors is not None), F.col("persisted"), F.col("records"), F.col("checkpoint"), F.col("backlog")).alias("recovery"),
        "total", "empty", "empty_ratio", "sessions", "open", "ready", "pending", "failed",
    )


def maintenance_counts(frames: DataFrame, elements: DataFrame) -> DataFrame:
    """How many frames have trees, elements or references that lead nowhere."""
    dangling = dangling_references(frames, elements).agg(F.count("*").alias("dangling"))
    counted = frames.agg(F.count("*").alias("frames"), F.count_if(F.coalesce("accessibility_tree_json", F.lit("")) != "").alias("with_tree"))
    return counted.crossJoin(elements.agg(F.count("*").alias("elements"))).crossJoin(dangling)  # one row each


def with_elements(frames: DataFrame, elements: DataFrame) -> DataFrame:
    """Frames whose elements exist: under the frame they refer to, or else their own id."""
    held = elements.select(F.col("frame_id").alias("_held")).distinct()
    return frames.join(held, F.coalesce("elements_ref_frame_id", "frame_id") == F.col("_held"), "left_semi")


def with_parents(elements: DataFrame) -> DataFrame:
    """Elements (frame_id, id, parent_id, role, text) with role and text of their parent, if it is there."""
    above = elements.select("frame_id", F.col("id").alias("parent_id"), F.col("role").alias("parent_role"), F.col("text").alias("parent_text"))
    return elements.join(above, ["frame_id", "parent_id"], "left")


def dangling_references(frames: DataFrame, elements: DataFrame) -> DataFrame:
    held = elements.select(F.col("frame_id").alias("elements_ref_frame_id"))
    return frames.filter("elements_ref_frame_id IS NOT NULL").join(held, "elements_ref_frame_id", "left_anti")
