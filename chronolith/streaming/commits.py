"""Line delta whose state follows what downstream work has accepted: pending frames are previewed, and committed or rolled back by a table of decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import committed
from ..operators.linedelta import told, trimmed_lines
from .streams import LineState, framed

ROWS = "kind string, context string, frame_id long, frame_timestamp timestamp, extracted_text string, committed boolean"
PENDING = "frame_id long, context string, frame_timestamp timestamp, came int, attempt int, has_lines boolean"
PREVIEW = "frame_id long, context string, ts_us long, attempt int, epoch long, kept_lines long, delta_text string"


def judged(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """pending with `open` (a decision on a tried frame of the context is missing) and `accepted`: decided so, and not after a rejected frame of its context that has lines."""
    place = F.struct("frame_timestamp", "frame_id")
    tried = pending.join(decisions.groupBy("frame_id").agg(F.min("committed").alias("_yes")), "frame_id", "left").withColumn("_tried", F.col("attempt") > 0)
    contexts = tried.groupBy("context").agg(F.max(F.col("_tried") & F.col("_yes").isNull()).alias("open"), F.min(F.when(F.col("_tried") & ~F.col("_yes") & F.col("has_lines"), place)).alias("_blocked"))
    out = tried.join(contexts, "context").withColumn("accepted", F.col("_tried") & F.coalesce("_yes", F.lit(False)) & (F.col("_blocked").isNull() | (place < F.col("_blocked"))))
    return out.drop("_yes", "_tried", "_blocked")


class Transactions:
    """Line delta of a stream of frames under a folder: `run` lets pending frames be tried and returns once nothing moves any more.

    Frames are previewed on top of the committed state, in order of time and id, and stay pending until a decision comes. Decisions are applied in the frames' order: an accepted frame becomes
    state, a rejected one is previewed again, with all that follow it. After a rejected frame that has lines none of the context is
    accepted, as its preview may have leant on lines that never became state. While decisions are open, new frames wait.

    attempt takes previews and returns them with `failed`. Of a micro-batch what comes before its first failed frame is accepted
    (`ingest.committed`), written to `accepted`, and told to a later micro-batch through the folder `decisions`, a stream of the next round; all else is tried again
    then. Each micro-batch writes folders of its own number, so that one that is replayed after a crash replaces what it wrote. Where an
    attempt comes out otherwise in the replay, the replay counts: the state hasn't seen the decisions before.
    """

    def __init__(self, path: str, idle: int, attempt: Callable[[DataFrame], DataFrame], context: str = "context_key"):
        self.path, self.idle, self.attempt, self.context = path, idle, attempt, context

    def _take(self, batch: DataFrame, number: int) -> DataFrame:
        """Make what the decisions of a micro-batch accept state, and write the previews of all that is pending then: tables of its number."""
        spark, state = self.spark, LineState(f"{self.path}/state", self.idle)
        at = lambda name, n=number: f"{self.path}/{name}/batch={n}"
        nothing = spark.createDataFrame([], PENDING)
        if number == 0:
            none = nothing.select("frame_id", "context", F.lit(1).alias("epoch"), F.lit(0).alias("seq"))
            state.save(0, nothing, none, none.select("context", "epoch", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")))
        batch.write.mode("overwrite").parquet(at("rows"))
        rows = spark.read.schema(ROWS).parquet(at("rows"))
        before = spark.read.schema(PENDING).parquet(at("pending", number - 1)) if number else nothing
        judged(before, rows.filter("kind = 'decision'")).write.mode("overwrite").parquet(at("judged"))
        held = spark.read.schema(f"{PENDING}, open boolean, accepted boolean").parquet(at("judged"))

        accepted = held.filter("accepted")
        placed = state.placed(accepted, number)
        fresh = state.fresh(placed, self._texts(accepted), number)
        state.save(number + 1, accepted, placed, fresh)

        has_lines = F.exists(trimmed_lines(F.col("extracted_text")), lambda x: x != "")
        new = rows.filter("kind = 'frame'").select("frame_id", "context", "frame_timestamp", F.lit(number).alias("came"), F.lit(0).alias("attempt"), F.coalesce(has_lines, F.lit(False)).alias("has_lines"))
        new = new.dropDuplicates(["frame_id"]).join(held.filter("NOT accepted"), "frame_id", "left_anti")  # a frame that comes again while it is pending is the same frame
        open_ = held.filter("open").select("context").distinct().withColumn("open", F.lit(True))
        rest = held.filter("NOT accepted").drop("open", "accepted").unionByName(new).join(open_, "context", "left")
        rest.select("frame_id", "context", "frame_timestamp", "came", F.when(F.col("open"), F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"), "has_lines", F.coalesce("open", F.lit(False)).alias("open")).write.mode("overwrite").parquet(at("pending"))
        tried = spark.read.schema(f"{PENDING}, open boolean").parquet(at("pending")).filter("NOT open")
        texts, placed = self._texts(tried), state.placed(tried, number + 1)
        shown = told(placed, texts, "context", state.fresh(placed, texts, number + 1)).withColumn("delta_text", F.coalesce("delta_text", F.lit("")))
        shown = shown.join(tried.select("frame_id", F.unix_micros("frame_timestamp").alias("ts_us"), "attempt"), "frame_id")
        shown.select(*[c.split()[0] for c in PREVIEW.split(", ")]).write.mode("overwrite").parquet(at("previews"))
        return spark.read.schema(PREVIEW).parquet(at("previews"))

    def _texts(self, frames: DataFrame) -> DataFrame:
        """(frame_id, extracted_text) of pending frames, from the micro-batches that they came with."""
        spark = self.spark
        came = [r["came"] for r in frames.select("came").distinct().collect()]  # numbers of micro-batches
        texts = spark.createDataFrame([], "frame_id long, extracted_text string, came int")
        for n in came:
            rows = spark.read.schema(ROWS).parquet(f"{self.path}/rows/batch={n}").filter("kind = 'frame'").select("frame_id", "extracted_text", F.lit(n).alias("came"))
            twice = rows.groupBy("frame_id").count().filter("count > 1")
            rows = rows if twice.isEmpty() else rows.dropDuplicates(["frame_id"])
            texts = rows if len(came) == 1 else texts.unionByName(rows)
        if len(came) > 1:  # a frame that was accepted may have come again
            texts = texts.join(frames.select("frame_id", "came"), ["frame_id", "came"], "left_semi")
        return texts.drop("came")

    def _decide(self, batch: DataFrame, number: int) -> None:
        spark = self.spark
        at = lambda name: f"{self.path}/{name}/batch={number}"
        previews = self._take(batch, number)
        self.attempt(previews).select(*previews.columns, "failed").write.mode("overwrite").parquet(at("attempts"))
        tried = spark.read.schema(f"{PREVIEW}, failed boolean").parquet(at("attempts"))
        placed = tried.withColumns({"frame_timestamp": F.timestamp_micros("ts_us"), "extracted_text": F.when(F.col("kept_lines") > 0, "x").otherwise("")})
        results = committed(placed, "context").drop("frame_timestamp", "extracted_text")
        results.filter("committed").drop("committed", "failed").write.mode("overwrite").parquet(at("accepted"))
        nothing = F.lit(None)
        decisions = results.select(F.lit("decision").alias("kind"), "context", "frame_id", F.timestamp_micros("ts_us").alias("frame_timestamp"), nothing.cast("string").alias("extracted_text"), "committed")
        decisions.write.mode("overwrite").parquet(at("decisions"))

    def _exists(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/decisions")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def _round(self, frames: DataFrame) -> None:
        spark = frames.sparkSession
        spark.createDataFrame([], ROWS).write.mode("ignore").parquet(f"{self.path}/decisions/batch=-1")
        decided = spark.readStream.schema(ROWS).option("pathGlobFilter", "*.parquet").parquet(f"{self.path}/decisions/batch=*")
        new = framed(frames, self.context).withColumns({"kind": F.lit("frame"), "committed": F.lit(None).cast("boolean")})
        self.spark = spark
        new.unionByName(decided).writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).foreachBatch(self._decide).start().awaitTermination()

    def counts(self, spark: SparkSession) -> tuple[int, int]:
        """(accepted frames, attempts) so far."""
        decisions = spark.read.schema(f"{ROWS}, batch int").parquet(f"{self.path}/decisions")
        r = decisions.filter("kind = 'decision'").agg(F.count_if("committed").alias("a"), F.count("*").alias("n")).first()
        return r["a"], r["n"]

    def run(self, frames: DataFrame, patience: int = 2) -> DataFrame:
        """All rounds over what the stream of frames has; the accepted (frame_id, context, epoch, kept_lines, delta_text, attempt).

        A round is a query that starts again from its checkpoint. Rounds end when one has nothing left to try, or after so many in a row that accept nothing.
        """
        spark = frames.sparkSession
        before, idle = self.counts(spark) if self._exists(spark) else (0, 0), 0
        while idle < patience:
            self._round(frames)
            now = self.counts(spark)
            if now == before or now[0] - before[0] == now[1] - before[1]:  # nothing was tried, or all that was tried is accepted
                break
            idle = idle + 1 if now[0] == before[0] else 0
            before = now
        return spark.read.schema(f"{PREVIEW}, batch int").parquet(f"{self.path}/accepted").select("frame_id", "context", "epoch", "kept_lines", "delta_text", "attempt")
