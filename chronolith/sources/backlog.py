"""History in pages: a window of time, ordered, cut into pages of so many rows, and a stream that brings a few pages a run."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W
from pyspark.errors import AnalysisException
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import fetch_window
from ..session import sliced


@dataclass(frozen=True)
class Backlog:
    """A window of time (ends as text, both included), as pages of `size` rows below `path`."""

    path: str
    start: str
    end: str
    rows: int
    size: int


def paged(history: DataFrame, path: str, size: int, start: str = "1970-01-01 00:00:00", end: str = "9999-12-31 23:59:59", ts: str = "frame_timestamp", frame: str = "frame_id", columns: list[Column] | None = None) -> Backlog:
    """Write the window of history below path, in the order of (ts, frame): a folder for each page, a page never over `size` rows. columns say what is written of a row: all it has, or what follows from it.

    Places come from slices of the order, whose counts (a row a slice) are summed up; a page is written by one task.
    """
    rows = history.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    placed = sliced(rows, [F.col(ts), F.col(frame)], "history")
    runs = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    runs = runs.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(ts, frame)) - 1
    numbered = placed.join(F.broadcast(runs), "_part").withColumn("page", F.floor(place / size).cast("long")).drop("_part", "_before")
    numbered.repartition("page").select(*([*columns, "page"] if columns else ["*"])).write.mode("overwrite").partitionBy("page").parquet(path)
    return Backlog(path, start, end, placed.count(), size)


class BacklogReader(SimpleDataSourceStreamReader):
    """Numbers of the next pages, with how many rows each must hold. The offset is what of the window has been taken: {from, to, offset}."""

    def __init__(self, options: dict[str, str]):
        self.start, self.end = options["from"], options["to"]
        self.rows, self.size, self.pages = (int(options[k]) for k in ("rows", "size", "pages"))

    def initialOffset(self) -> dict:
        return {"from": self.start, "to": self.end, "offset": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = -(-start["offset"] // self.size)  # the last page may be a short one
        past = min(first + self.pages, -(-self.rows // self.size))
        end = start | {"offset": max(start["offset"], min(self.rows, past * self.size))}
        return self._pages(first, past), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._pages(-(-start["offset"] // self.size), -(-end["offset"] // self.size))

    def _pages(self, first: int, past: int) -> Iterator[tuple]:
        return iter([(page, min(self.size, self.rows - page * self.size)) for page in range(first, past)])


class BacklogSource(DataSource):
    """Spark's format "backlog": a stream of (page, rows). Options: from, to, rows, size, and how many pages a micro-batch takes."""

    @classmethod
    def name(cls) -> str:
        return "backlog"

    def schema(self) -> str:
        return "page long, rows long"

    def simpleStreamReader(self, schema) -> BacklogReader:
        return BacklogReader(self.options)


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _numbers(spark: SparkSession, backlog: Backlog, pages: int) -> DataFrame:
    spark.dataSource.register(BacklogSource)
    options = {"from": backlog.start, "to": backlog.end, "rows": backlog.rows, "size": backlog.size, "pages": pages}
    return spark.readStream.format("backlog").options(**{k: str(v) for k, v in options.items()}).load()


def stream_pages(spark: SparkSession, backlog: Backlog, pages: int, at: int | None = None) -> DataFrame:
    """The rows of a backlog as a stream, `pages` pages a micro-batch. Only page numbers go through the driver.

    A page that has other than the rows it must hold makes no progress: the query fails. Spark doesn't prune folders by a stream's rows, so a micro-batch looks
    into all pages, unless `at` says how much of the backlog is taken: then the stream brings one micro-batch, and only its folders are read.
    """
    numbers = _numbers(spark, backlog, pages)
    folders = [backlog.path]
    if at is not None:
        first = -(-at // backlog.size)
        folders = [f"{backlog.path}/page={page}" for page in range(first, min(first + pages, -(-backlog.rows // backlog.size)))]
        if not all(_there(spark, folder) for folder in folders):
            raise RuntimeError(f"no progress beyond backlog offset {at}")
    stored = spark.read.option("basePath", backlog.path).parquet(*folders).withColumn("page", F.col("page").cast("long"))
    names = [c for c in stored.columns if c != "page"]
    held = stored.groupBy("page").agg(F.count("*").alias("_held"))  # from the files' footers
    checked = numbers.filter("page >= 0").join(F.broadcast(held), "page", "left")
    stuck = F.concat(F.lit("no progress beyond backlog offset "), (F.col("page") * backlog.size).cast("string"))
    checked = checked.select(F.when(F.coalesce("_held", F.lit(0)) == F.col("rows"), F.col("page")).otherwise(F.raise_error(stuck).cast("long")).alias("page"))
    return stored.join(F.broadcast(checked), "page").select(*names)  # a few numbers a micro-batch


def offset_of(query: StreamingQuery) -> int | None:
    """How far into its backlog a query has come; None if it had nothing to do."""
    ends = [re.search(r"\boffset\W+(\d+)", str(p["sources"][0]["endOffset"])) for p in query.recentProgress if p["sources"]]
    return max((int(m[1]) for m in ends if m), default=None)


def replayed(spark: SparkSession, backlog: Backlog, pages: int, run: Callable[[DataFrame], StreamingQuery]) -> int:
    """Let run start a query (trigger availableNow) on the stream of pages, again and again from its checkpoint, until all of the backlog is taken; how many runs that took.

    A run that fails ends the replay, and so does one that doesn't move: both raise. What was taken before stays, and the next replay goes on from there.
    """
    at, runs = -1, 0
    while at < backlog.rows:
        query = run(stream_pages(spark, backlog, pages, at if runs else None))
        query.awaitTermination()
        runs += 1
        reached = offset_of(query)
        if reached is None:  # nothing was left
            break
        if reached <= at:
            raise RuntimeError(f"no progress beyond backlog offset {at}")
        at = reached
    return runs


#: Up to this sum of its rows' weights, what a run shuffles goes to one task.
LIGHT = 100_000


def replayed_in_one(spark: SparkSession, backlog: Backlog, pages: int, checkpoint: str, take: Callable[[DataFrame, int, int], None], weight: str = "1") -> int:
    """Take what is left of a backlog, `pages` pages a run, in one query whose micro-batches are the runs; how many there were. take gets the rows of a run, its number and the sum of the rows' weights.

    A run begins when the one before it is in the checkpoint, and reads its own folders only. A page that isn't there, or has other than the rows it must hold, ends the
    query before anything is taken of its run; the next replay goes on from there. Runs are planned in the query's own session, without adaptive execution: they are small.
    """
    schema, runs = None, 0

    def run(batch: DataFrame, number: int) -> None:
        nonlocal schema, runs
        own = batch.sparkSession
        own.conf.set("spark.sql.adaptive.enabled", "false")
        wanted = {r["page"]: r["rows"] for r in batch.collect()}  # a few numbers
        folders = {page: f"{backlog.path}/page={page}" for page in sorted(wanted)}
        try:
            schema = schema or own.read.option("basePath", backlog.path).parquet(folders[min(wanted)]).withColumn("page", F.col("page").cast("long")).schema
            rows = own.read.schema(schema).option("basePath", backlog.path).parquet(*folders.values())
        except AnalysisException as e:
            gone = [page * backlog.size for page, folder in folders.items() if not _there(spark, folder)]
            if not gone:
                raise
            raise RuntimeError(f"no progress beyond backlog offset {gone[0]}") from e
        held = rows.coalesce(1).selectExpr(*[f"count_if(page = {page}) AS p{page}" for page in folders], f"sum({weight}) AS weight").first()
        stuck = [page * backlog.size for page in folders if held[f"p{page}"] != wanted[page]]
        if stuck:
            raise RuntimeError(f"no progress beyond backlog offset {stuck[0]}")
        own.conf.set("spark.sql.shuffle.partitions", "1" if (held["weight"] or 0) <= LIGHT else spark.conf.get("spark.sql.shuffle.partitions"))
        take(rows.drop("page"), number, held["weight"] or 0)
        runs += 1

    query = _numbers(spark, backlog, pages).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).start()
    try:
        query.processAllAvailable()  # a backlog has an end
    finally:
        query.stop()
    return runs


def window_of(checkpoint: datetime | None, now: datetime, window: int = 15, batches: int = 3) -> tuple[datetime, datetime] | None:
    """The window of a backlog; none while the checkpoint is within the minutes that a fetch reaches back (`ingest.fetch_window`). It starts at the checkpoint, but no earlier than a fetch reaches."""
    lag = None if checkpoint is None else max(0.0, (now - checkpoint).total_seconds() / 60)
    minutes, needed = fetch_window(lag, window, batches)
    earliest = now - timedelta(minutes=minutes)
    return (earliest if checkpoint is None else max(checkpoint, earliest), now) if needed else None
