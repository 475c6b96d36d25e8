"""Structured Streaming forms of sessions and line delta."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.util import inheritable_thread_target

from ..operators.linedelta import KEY, epochs, epochs_of_few, first_lines, first_lines_of_few, told, told_of_few
from ..session import few, materialize


def stream_sessions(frames: DataFrame, keys: list[str], idle: int, watermark: str | None = None) -> DataFrame:
    """Gap sessions of a stream: bounds and number of frames. With a watermark sessions come once they are final (append mode); without, in complete mode."""
    seen = frames.withWatermark("frame_timestamp", watermark) if watermark else frames
    out = seen.groupBy(*keys, F.session_window("frame_timestamp", f"{idle} seconds")).agg(F.count("*").alias("frames"), F.max("frame_timestamp").alias("ended_at"))
    return out.select(*keys, F.col("session_window.start").alias("started_at"), "ended_at", "frames")


SEEN, LAST = "context string, epoch long, h1 long, h2 long", "context string, last timestamp, epoch long"
FRAME = "frame_id long, context string, frame_timestamp timestamp, extracted_text string"
DELTA = "frame_id long, context string, epoch long, kept_lines long, delta_text string"

#: Lines of a micro-batch that are looked for in what was seen without moving it, and files of the table of contexts after few frames.
MATCHED, FILES = 100_000, 8


class LineState:
    """What contexts have shown since their epochs began, as tables below a folder: when each was last seen and in which epoch, and the hashes of the lines of that epoch.

    Each step (a micro-batch) writes tables of its own number and reads those of earlier ones, so a step that is replayed replaces itself. A line's hash is written once, and
    again with every `every`th step, which leaves ended epochs out: a step reads so many tables at most. Nothing is keyed by context alone, as one may hold most of the frames.
    """

    def __init__(self, path: str, idle: int, every: int = 32):
        self.path, self.idle, self.every = path, idle, every

    def _at(self, name: str, step: int) -> str:
        return f"{self.path}/{name}/batch={step}"

    def last(self, spark: SparkSession, step: int) -> DataFrame:
        """(context, last, epoch) after a step; nothing before the first one."""
        return spark.read.schema(LAST).parquet(self._at("last", step)) if step >= 0 else spark.createDataFrame([], LAST)

    def seen(self, spark: SparkSession, step: int) -> DataFrame:
        """(context, epoch, h1, h2) after a step."""
        whole = step - step % self.every
        return spark.read.schema(SEEN).parquet(*[self._at("seen", n) for n in range(whole, step + 1)]) if step >= 0 else spark.createDataFrame([], SEEN)

    def placed(self, frames: DataFrame, step: int) -> DataFrame:
        """(frame_id, context, epoch, seq) of frames that come after a step."""
        return materialize(epochs(frames, "context", self.idle, self.last(frames.sparkSession, step)), "placed")

    def fresh(self, placed: DataFrame, texts: DataFrame, step: int) -> DataFrame:
        """(context, epoch, h1, h2, frame_id, at) of the lines of placed frames that weren't seen up to a step."""
        first = materialize(first_lines(placed, texts, "context"), "first")
        return self._unseen(first, few(first, MATCHED), step)

    def _unseen(self, first: DataFrame, is_few: bool, step: int) -> DataFrame:
        seen, key = self.seen(first.sparkSession, step), ["context", *KEY]
        if is_few:  # what was seen stays where it is
            seen = seen.join(F.broadcast(first.select(*key)), key, "left_semi")
            return first.join(F.broadcast(seen), key, "left_anti")
        return first.join(seen, key, "left_anti")

    def save(self, step: int, frames: DataFrame, placed: DataFrame, fresh: DataFrame) -> None:
        """Make placed frames and their fresh lines state, as a step of that number."""
        self._save_last(step, placed.join(frames.select("frame_id", "frame_timestamp"), "frame_id"))
        self._save_seen(step, fresh)

    def take_few(self, step: int, frames: DataFrame, lines: int, out: str) -> None:
        """Write what is told of few frames (`linedelta.line_columns`), which come after a step and have so many lines, to out, and make them state as the next step.

        One task orders the frames and finds their lines, so nothing is shuffled; what was seen before is looked through by many. What follows from these lines is written side by side.
        """
        placed = epochs_of_few(frames.coalesce(1), "context", self.idle, self.last(frames.sparkSession, step)).persist()
        fresh = self._unseen(first_lines_of_few(placed, "context"), lines <= MATCHED, step).persist()
        whole, in_thread = (step + 1) % self.every == 0, inheritable_thread_target(frames.sparkSession)  # jobs are the query's, and end with it
        try:
            with ThreadPoolExecutor(3) as beside:
                ends = beside.submit(in_thread(self._save_last), step + 1, placed, True)
                shown = beside.submit(in_thread(lambda: told_of_few(placed, "context", fresh).write.mode("overwrite").parquet(out)))
                if whole:  # the lines of epochs that have ended go, so these must be known
                    ends.result()
                seen = beside.submit(in_thread(self._save_seen if whole else self._add_seen), step + 1, fresh)
                for done in (ends, shown, seen):
                    done.result()
        finally:
            fresh.unpersist()
            placed.unpersist()

    def _add_seen(self, step: int, fresh: DataFrame) -> None:
        fresh.select("context", *KEY).write.mode("overwrite").parquet(self._at("seen", step))

    def _save_last(self, step: int, placed: DataFrame, is_few: bool = False) -> None:
        spark = placed.sparkSession
        ends = placed.groupBy("context").agg(F.expr("max(struct(epoch, frame_timestamp)) AS _e"))
        ends = ends.selectExpr("context", "_e.frame_timestamp AS last", "CAST(_e.epoch AS LONG) AS epoch")
        before = self.last(spark, step - 1)
        after = ends.unionByName(before.join(F.broadcast(ends) if is_few else ends, "context", "left_anti"))
        (after.coalesce(FILES) if is_few else after).write.mode("overwrite").parquet(self._at("last", step))

    def _save_seen(self, step: int, fresh: DataFrame) -> None:
        spark = fresh.sparkSession
        new = fresh.select("context", F.col("epoch").cast("long").alias("epoch"), "h1", "h2")
        if step % self.every == 0:
            new = new.unionByName(self.seen(spark, step - 1))
        open_ = self.last(spark, step).select("context", "epoch")
        new.join(open_, ["context", "epoch"], "left_semi").write.mode("overwrite").parquet(self._at("seen", step))


def framed(frames: DataFrame, context: str) -> DataFrame:
    """frames as (frame_id, context, frame_timestamp, extracted_text)."""
    return frames.select("frame_id", F.col(context).alias("context"), "frame_timestamp", "extracted_text")


def started_line_delta(frames: DataFrame, path: str, context: str, idle: int, known: DataFrame | None = None) -> StreamingQuery:
    """A query over what is there of a stream of frames, which writes (frame_id, context, epoch, kept_lines, delta_text) below path/out, a folder a micro-batch.

    A new query may go on where another one ended: known has the frames of the open sessions up to there (`ingest.hydrated`), which become
    the state of their contexts. It counts when the query has no checkpoint yet; epochs are numbered from that of the open session, 1.
    """
    state, spark = LineState(f"{path}/state", idle), frames.sparkSession  # a micro-batch's own session plans without adaptive execution

    def write(batch: DataFrame, number: int) -> None:
        if number == 0:  # step 0 is what was known before
            begun(spark, state, None if known is None else framed(known, context))
        batch.write.mode("overwrite").parquet(f"{path}/frames/batch={number}")
        rows = spark.read.schema(FRAME).parquet(f"{path}/frames/batch={number}")
        placed = state.placed(rows, number)
        fresh = materialize(state.fresh(placed, rows, number), "fresh")
        told(placed, rows, "context", fresh).withColumn("delta_text", F.coalesce("delta_text", F.lit(""))).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        state.save(number + 1, rows, placed, fresh)

    return framed(frames, context).writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()


def begun(spark: SparkSession, state: LineState, known: DataFrame | None) -> None:
    """Make what was known before step 0 of a state; nothing, in most cases."""
    old = spark.createDataFrame([], FRAME) if known is None else materialize(known, "known")
    one = old.select("frame_id", "context", F.lit(1).alias("epoch"), F.lit(0).alias("seq"))
    state.save(0, old, one, first_lines(one, old, "context"))


def line_delta_of_few(path: str, idle: int) -> Callable[[DataFrame, int, int], None]:
    """What takes the stored frames of a micro-batch (`linedelta.line_columns`), few at a time, its number and how many lines they have, and writes what `started_line_delta` would below path/out."""
    state = LineState(f"{path}/state", idle)

    def take(frames: DataFrame, number: int, lines: int) -> None:
        if number == 0:
            begun(frames.sparkSession, state, None)
        state.take_few(number, frames, lines, f"{path}/out/batch={number}")

    return take


def stream_line_delta(frames: DataFrame, path: str, context: str, idle: int, known: DataFrame | None = None) -> DataFrame:
    """`started_line_delta` over what is there, and all that it and earlier runs wrote."""
    started_line_delta(frames, path, context, idle, known).awaitTermination()
    return frames.sparkSession.read.schema(DELTA).parquet(f"{path}/out")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which arbitrary state needs; the session's setting is as before afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def started(stream: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """A query over what is there, which writes below path/out. Each micro-batch has a folder of its own, so a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        name = f"batch={0 if mode == 'complete' else number}"  # a complete result replaces the one before
        batch.write.mode("overwrite").parquet(f"{path}/out/{name}")

    with rocksdb(stream.sparkSession):
        return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return all that it and earlier runs wrote."""
    started(stream, path, mode).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
