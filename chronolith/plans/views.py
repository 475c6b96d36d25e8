"""The tables that queries run on, bridged from the driver's star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

IDLE = 14_400
USER = ["user_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("ts").cast("timestamp").alias("frame_timestamp"), F.col("event_type").alias("app_name"), "user_id")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.col("source").alias("window_name"), "lang", F.col("text").alias("extracted_text"))
    return e.join(d, "frame_id")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("frame_id"), F.col("ts").cast("timestamp").alias("frame_timestamp"), F.col("event_type").alias("app_name"), "user_id", "value"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").cast("timestamp").alias("frame_timestamp"), F.col("event_type").alias("app_name"))
    return table(spark, sf_dir, "embeddings").join(e, "vec_id").withColumn("id", F.concat(F.lit("extracted:"), F.col("vec_id").cast("string")))


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


#: The same views for DuckDB, as the head of a WITH.
FRAMES_SQL = """frames AS (SELECT e.event_id AS frame_id, e.ts AS frame_timestamp, e.event_type AS app_name, e.user_id,
  d.source AS window_name, d.lang, d.text AS extracted_text FROM events e JOIN documents d ON e.event_id = d.doc_id)"""
NUMBERED_SQL = """gaps AS (SELECT event_id AS frame_id, ts, event_type AS app_name, user_id,
    (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events),
  numbered AS (SELECT *, sum(CASE WHEN gap <= 14400 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) - 1 AS n FROM gaps),
  owned AS (SELECT frame_id, ts, app_name, user_id, CASE WHEN gap <= 14400 THEN gap END AS gap,
    coalesce(CAST(user_id AS VARCHAR), '') || '#' || CAST(CAST(n AS BIGINT) AS VARCHAR) AS session_id FROM numbered),
  sessions AS (SELECT user_id, session_id, min(ts) AS started_at, max(ts) AS ended_at, coalesce(sum(gap), 0) AS active, count(*) AS frames FROM owned GROUP BY ALL)"""
