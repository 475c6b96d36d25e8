"""Readers and small sinks: captures, derived tables, JSON and text files, logs, folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

CAPTURE = "id string, text string, timestamp string, appName string, windowName string, frameId long, sourceTypes array<string>, role string, parentId string, path string, accessibilityTreeJson string"
ROUTINE = "name string, schedule string, enabled boolean, prompt string, recentActivityMinutes int, createdAt timestamp, updatedAt timestamp"
VECTOR = "id string, text string, timestamp string, appName string, windowName string, sourceTypes array<string>, embedding array<double>, metadata struct<sourceTypes:array<string>,frameId:long,frameTimestamp:string>"
PRIVACY = "paused boolean, excludedApps array<string>, pauseStartedAt timestamp, suppressedRanges array<struct<`from`:timestamp,`to`:timestamp,reason:string,failedFrameIds:array<long>,createdAt:timestamp,resolvedAt:timestamp>>"


def captures(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Capture records landed as JSON lines, as a table or a rate-limited stream; times without a zone are dropped."""
    from ..functions.values import utc_timestamp

    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.schema(CAPTURE).json(path)
    return raw.withColumn("timestamp", utc_timestamp(F.col("timestamp"))).filter("timestamp IS NOT NULL")


def routines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROUTINE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def vectors_file(spark: SparkSession, path: str) -> DataFrame:
    """Vector records of a JSON file {"records": [...]}; none where there is no file, an error where it isn't of that form."""
    if not exists(spark, path):
        return spark.createDataFrame([], VECTOR)
    read = spark.read.schema(f"records array<struct<{VECTOR}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    listed = F.when(F.col("records").isNull(), F.raise_error(F.lit("no records in a vector file"))).otherwise(F.col("records"))
    records = read.select(F.explode(listed).alias("r")).select("r.*")
    whole = F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("timestamp").isNotNull()
    return records.withColumn("id", F.when(whole, F.col("id")).otherwise(F.raise_error(F.lit("a vector record without id, text or time"))))


def checkpoint_file(spark: SparkSession, path: str) -> DataFrame:
    """The row (timestamp, cursor) of a checkpoint file; none where there is no file."""
    schema = "timestamp string, cursor string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def suppressed_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Unresolved suppressed ranges (from, to, reason) of a privacy file."""
    state = spark.read.schema(PRIVACY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return state.select(F.explode("suppressedRanges").alias("r")).select("r.*").filter("resolvedAt IS NULL").select("from", "to", "reason")


def memory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(scope, content) of whole text files."""
    parts = [spark.read.text(p, wholetext=True).select(F.lit(s).alias("scope"), F.col("value").alias("content")) for s, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What is read of a log at once, and at most.
LOG_CHUNK, LOG_MOST = 64 << 10, 10 << 20


def tail_lines(spark: SparkSession, path: str, wanted: int, chunk: int = LOG_CHUNK, most: int = LOG_MOST) -> tuple[list[str], int]:
    """(the last `wanted` lines that aren't blank, in order; bytes read) of a log file, or of a folder of them in order of their names.

    Files are read from their ends, a chunk at a time, until there are enough lines or `most` bytes are read. A line that begins before these bytes is left out.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return [], 0
    found: list[bytes] = []
    read = 0
    for file in sorted((x for x in system.listStatus(at) if x.isFile()), key=lambda x: x.getPath().getName(), reverse=True):
        stream, place, held = system.open(file.getPath()), file.getLen(), b""
        try:
            while place > 0 and read < most and len(found) + sum(bool(x.strip()) for x in held.split(b"\n")[1:]) < wanted:
                size = min(chunk, place, most - read)
                place, read = place - size, read + size
                stream.seek(place)
                held = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) + held
        finally:
            stream.close()
        whole = held.split(b"\n")[0 if place == 0 else 1 :]
        found = [x for x in whole if x.strip()] + found
        if len(found) >= wanted or read >= most:
            break
    return [x.decode("utf-8", "replace").rstrip("\r") for x in found[-wanted:]], read


def log_tail(spark: SparkSession, path: str, limit: int = 200, level: str | None = None) -> DataFrame:
    """The last lines of a log, newest first; JSON lines are parsed, others are kept raw and have no level. Levels are compared in any case.

    Of the log only its end is read (`tail_lines`): so many lines, or, to find those of one level, LOG_MOST bytes. At most 1,000 lines come.
    """
    most = min(max(limit, 1), 1000)
    lines, _ = tail_lines(spark, path, most if level is None else LOG_MOST)
    rows = spark.createDataFrame(list(enumerate(lines)), "at long, raw string")
    rows = rows.select("at", F.get_json_object("raw", "$.level").alias("level"), F.get_json_object("raw", "$.message").alias("message"), "raw")
    rows = rows if level is None else rows.filter(F.lower("level") == level.lower())
    return rows.orderBy(F.desc("at")).limit(most).drop("at")


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(exists, files, bytes) below a folder; contents are not read."""
    if not exists(spark, path):
        return spark.createDataFrame([(False, 0, 0)], "exists boolean, files long, bytes long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.agg(F.lit(True).alias("exists"), F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def table_bytes(spark: SparkSession, root: str) -> DataFrame:
    """(name, bytes) of each table folder or file under root, largest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.regexp_extract("path", re.escape(root.rstrip("/").removeprefix("file://")) + "/([^/]+)", 1)
    return files.groupBy(name.alias("name")).agg(F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), "name")


def between(frames: DataFrame, start, end, ts: str = "frame_timestamp") -> DataFrame:
    return frames.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy(ts)


def recent(frames: DataFrame, minutes: int, now=None, ts: str = "frame_timestamp") -> DataFrame:
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return frames.filter(F.col(ts).between(at - F.make_interval(mins=F.lit(minutes)), at))


def by_ids(frames: DataFrame, ids: DataFrame, key: str = "frame_id") -> DataFrame:
    return frames.join(ids.select(key).distinct(), key, "left_semi")


def published(df: DataFrame, path: str) -> None:
    """Replace a table's folder by df through Spark's commit protocol. df must not read that folder."""
    df.write.mode("overwrite").parquet(path)
