"""Summaries of sessions: what is there is kept, a provider is asked for the rest, and a template stands in for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import narratives
from .pool import called

INPUT = ["session_id", "app_name", "context_label", "started_at", "ended_at", "active_seconds", "frames"]
SUMMARY = ["session_id", "summary_text", "summary_status", "summary_provider_kind", "summary_generated_at"]


def ensured(wanted: DataFrame, sessions: DataFrame, provider: Callable[[dict], str] | None, kind: str, paused: Column, now: Column, bound: int = 2, tasks: int = 1, evidence: DataFrame | None = None) -> DataFrame:
    """(session_id, summary_text, summary_status, summary_provider_kind, summary_generated_at, stored) for each session_id of wanted.

    * A session that isn't there: failed, without a text; nothing is to be stored.
    * One that is ready and has a text keeps it; nobody is asked.
    * While capture is paused, or nobody can tell (paused is null), the template is the provider: its text is ready, and nothing leaves the cluster. So it is without a provider.
    * Otherwise the provider is called with the columns INPUT (and the session's `fragments`, if evidence (session_id, fragments) is given), at most `bound` calls at a time. Its text is ready.
    * If it raises or gives nothing, the template's text stands in: degraded.
    * If the template can't be filled either (a part of it is null): failed; the text that was stored stays.

    stored says whether the session's row changes; `ingest.updated` puts such rows in.
    """
    known = ["summary_text", "summary_status", "summary_provider_kind", "summary_generated_at"]
    asked = wanted.select("session_id").distinct()
    found = sessions.select(*INPUT, *[F.col(c).alias(f"_{c}") for c in known], F.lit(True).alias("_there")).join(asked, "session_id", "left_semi")
    ready = (F.col("_summary_status") == "ready") & F.col("_summary_text").isNotNull()
    found = found.withColumn("_ready", F.coalesce(ready, F.lit(False))).withColumn("_template", narratives.summary(*[F.col(c) for c in INPUT[1:]]))
    free = F.lit(False) if provider is None else ~F.coalesce(paused, F.lit(True))
    found = found.withColumn("_free", free & ~F.col("_ready"))
    written = found.filter("_free").select(*INPUT)
    written = written if evidence is None else written.join(evidence.select("session_id", "fragments"), "session_id", "left")
    texts = called(written, provider, "string", bound, tasks).select("session_id", F.nullif("value", F.lit("")).alias("_written")) if provider else written.select("session_id", F.lit(None).cast("string").alias("_written"))
    rows = asked.join(found, "session_id", "left").join(texts, "session_id", "left")
    there = F.coalesce("_there", F.lit(False))
    status = (
        F.when(~there, "failed").when(F.col("_ready") | F.col("_written").isNotNull(), "ready")
        .when(F.col("_template").isNull(), "failed").when(F.col("_free"), "degraded").otherwise("ready")
    )
    rows = rows.withColumn("summary_status", status)
    failed, own = F.col("summary_status") == "failed", F.col("_written").isNotNull()
    return rows.select(
        "session_id",
        F.when(failed, F.col("_summary_text")).when(F.col("_ready"), F.col("_summary_text")).otherwise(F.coalesce("_written", "_template")).alias("summary_text"),
        "summary_status",
        F.when(failed, "template").when(F.col("_ready"), F.coalesce("_summary_provider_kind", F.lit("template"))).when(own, kind).otherwise("template").alias("summary_provider_kind"),
        F.when(F.col("_ready") | failed, F.col("_summary_generated_at")).otherwise(now).alias("summary_generated_at"),
        (there & ~F.col("_ready")).alias("stored"),
    )


def stored(sessions: DataFrame, ensured_rows: DataFrame) -> DataFrame:
    """sessions with the summaries of those rows that are to be stored; a failed one changes the status alone."""
    new = ensured_rows.filter("stored").select("session_id", *[F.col(c).alias(f"_{c}") for c in SUMMARY[1:]])
    changed = F.col("_summary_status").isNotNull()
    whole = changed & (F.col("_summary_status") != "failed")
    put = {c: F.when(changed if c == "summary_status" else whole, F.col(f"_{c}")).otherwise(F.col(c)) for c in SUMMARY[1:]}
    return sessions.join(new, "session_id", "left").select(*[put.get(c, F.col(c)).alias(c) for c in sessions.columns])
