"""Session set-up, shared-folder tables and ranks that no single task computes."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    root = str(Path(__file__).resolve().parents[1])
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))  # for Python workers
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronolith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and all run on one machine, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir isn't set, and executors of {master} have no folder in common with the driver")
        path = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{intermediate_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def intermediate_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_dir(spark)}/chronolith-{spark.sparkContext.applicationId}"


def clear_intermediate(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application, once results that read them have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(intermediate_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(df: DataFrame, order: list[Column], name: str, part: str = "_part") -> DataFrame:
    """df range-partitioned by order, written, with the number of each row's slice: slices follow each other in order.

    Running sums over a whole table go over its slices, then over the table of slices (a row each), so that no task orders all rows.
    """
    return materialize(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn(part, F.spark_partition_id()), name)


def few(df: DataFrame, most: int = 10_000) -> bool:
    """Whether df has at most so many rows; counts no further than that. What this is true of may be broadcast."""
    return df.limit(most + 1).count() <= most


def ranked(df: DataFrame, key: str, order: list[Column], name: str, rank: str = "rank") -> DataFrame:
    """Add the gapless rank (from 0) of each row among the rows of its key, in the order given.

    A window over a key with a third of all rows would sort them in one task. Here rows are range-partitioned
    by (key, order), so that a hot key spreads over many tasks; each row keeps its place in its partition, and only the
    (partition, key) counts, a table of about partitions + keys rows, are summed up. Rows with equal order get
    distinct ranks in any order, but share a task: callers end the order with a stored row number. Keys must not be null.
    """
    spark = df.sparkSession
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(
        df.repartitionByRange(shuffle_partitions(spark), F.col(key), *order)
        .sortWithinPartitions(F.col(key), *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_index", index),
        name,
    )
    runs = placed.groupBy("_part", key).agg(F.min("_index").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("_part", key, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(runs, ["_part", key]).withColumn(rank, F.col("_index") + F.col("_shift")).drop("_part", "_index", "_shift")
