"""Calls of a slow provider for many rows: so many at a time in all, with an outcome for each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def outcomes(call: Callable[[dict], object], rows: list[dict], bound: int) -> list[tuple]:
    """(value, error) of each row, in the order of the rows; at most `bound` calls are in flight, and the next one starts as soon as any ends. What a call raises is its row's outcome."""

    def one(row: dict) -> tuple:
        try:
            return call(row), None
        except Exception as e:  # noqa: BLE001  whatever the provider raises
            return None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(bound) as threads:
        return list(threads.map(one, rows))


def called(rows: DataFrame, call: Callable[[dict], object], kind: str, bound: int = 2, tasks: int = 1) -> DataFrame:
    """rows with value (of the DDL type kind) and error (null if the call went well) by call(row as a dict).

    No more than `bound` calls are in flight at any time on the whole cluster: rows are dealt to `tasks` tasks (`bound` at most), which share the bound. Rows of a task
    keep their order. A task holds one batch of rows from Arrow. A task that is lost is run again, and so are its calls.
    """
    tasks = max(1, min(tasks, bound))
    each, names = bound // tasks, rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = outcomes(call, batch.to_dict("records"), each)
            columns = {c: pd.Series([x[i] for x in done], index=batch.index, dtype=object) for i, c in enumerate(("value", "error"))}
            yield batch.assign(**columns)[[*names, "value", "error"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(tasks).mapInPandas(run, f"{schema}, value {kind}, error string")


def embedding_outcomes(frames: DataFrame, cache: DataFrame, embed: Callable[[str], list[float]], bound: int = 2, tasks: int = 1) -> DataFrame:
    """frames (frame_id, frame_timestamp, extracted_text, text_hash) with embedding, outcome and error; cache has (hash, embedding).

    Outcomes: skipped-empty (no text), reused-hash (in the cache, or as a frame before it in this run), computed, provider-unavailable (with its error). Each distinct text that the cache lacks
    is embedded once, for the frame that comes first by time and id; where that fails, all frames of the text have failed. Skipped frames don't hold the checkpoint
    back, failed ones do (`ingest.checkpoint`).
    """
    some = frames.filter(F.coalesce("extracted_text", F.lit("")) != "")
    known = cache.select(F.col("hash").alias("text_hash"), F.col("embedding").alias("_known"))
    missing = some.join(known.select("text_hash"), "text_hash", "left_anti")
    first = missing.groupBy("text_hash").agg(F.min("extracted_text").alias("text"), F.min(F.struct("frame_timestamp", "frame_id")).alias("_first"))
    new = called(first, lambda row: embed(row["text"]), "array<double>", bound, tasks)
    new = new.select("text_hash", F.col("_first.frame_id").alias("_by"), F.col("value").alias("_new"), F.col("error"))
    out = frames.join(known, "text_hash", "left").join(new, "text_hash", "left")
    outcome = (
        F.when(F.coalesce("extracted_text", F.lit("")) == "", "skipped-empty").when(F.col("_known").isNotNull(), "reused-hash")
        .when(F.col("_new").isNull(), "provider-unavailable").when(F.col("_by") == F.col("frame_id"), "computed").otherwise("reused-hash")
    )
    usable = outcome != "skipped-empty"
    return out.select(*frames.columns, F.when(usable, F.coalesce("_known", "_new")).alias("embedding"), outcome.alias("outcome"), F.when(usable & F.col("_known").isNull(), F.col("error")).alias("error"))
