"""A training corpus from `documents` in five stages, each of which calls one operator of chronolith.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Rows, not doc_ids, are what stages decide on: null and repeated ids are fine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronolith.llm import jaccard_join, mixing, packing, pii, quality_rules
from chronolith.llm.text import n_words
from chronolith.session import intermediate_dir, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Up to so many decisions (16 bytes each) reach the texts by broadcast; beyond it, texts are shuffled to them.
BROADCAST_ROWS = 500_000


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row: its file and its place there, however a read of the Parquet files is cut into partitions."""
    files = docs.select(F.col("_metadata.file_path").alias("file")).distinct().collect()  # one row a file
    numbers = docs.sparkSession.createDataFrame([(r["file"], i << 40) for i, r in enumerate(sorted(files))], "file string, first long")
    placed = docs.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
    return placed.join(F.broadcast(numbers), "file").select(*COLUMNS, (F.col("first") + F.col("index")).alias("row"))


def _decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs (with row) joined with what was decided on rows."""
    decisions = materialize(decisions, "decisions")
    return docs.join(F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions, "row")


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go; documents that fail the base rules or lose too much text go."""
    kept = quality_rules.clean_lines(docs.select(*COLUMNS)).filter("kept")
    return _resized(kept.withColumn("text", F.col("clean_text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity of 0.75 or more, the first stays."""
    docs = _numbered(docs)
    groups = jaccard_join.jaccard_components(docs.select(F.col("row").alias("doc_id"), "text"))
    return _decided(docs, groups.filter("doc_id = component_id").select(F.col("doc_id").alias("row"))).select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of their format."""
    return _resized(pii.pseudonymized(docs.select(*COLUMNS), counts=False))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: documents are left out, taken, or taken twice."""
    docs = _numbered(docs)
    plan = mixing.mixed(docs.select("row", "doc_id", "source", n_words(F.col("text")).alias("size")))
    taken = _decided(docs, plan.filter("copies > 0").select("row", "copies"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenized and packed into sequences of 1024 tokens."""
    return packing.packed(packing.pieces(docs.select("doc_id", "text")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can't express components, the cube method or tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    path = f"{intermediate_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
