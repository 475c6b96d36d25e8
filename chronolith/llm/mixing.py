r"""Mixing sources to target weights by the cube method (balanced sampling, Deville and Tille 2004).

Each source gets a target number of words; a document of the source is then wanted target / source words times. The whole
part of that number is taken as it is. The fractional part is an inclusion probability, and the cube method turns these
into 0 or 1 while two totals of each source stay where they are: its words and its documents.

Flight: three undecided documents at a time move along the vector that leaves both totals unchanged, until one of
them reaches 0 or 1. It runs in blocks of about a thousand documents of one source, which Spark spreads; a block leaves at
most two documents undecided. Those form the blocks of the next level, until one block a source is left, and
a dozen documents of all sizes and what the flight leaves land on the 0/1 choice that is nearest to the totals.

Blocks come from a hash of doc_id, size and row, order in them from the same, draws from a generator seeded with source and block:
reruns agree however the input is partitioned. Null sources are a source, null texts have no words, rows with equal or null
doc_id are separate documents, and an empty table gives an empty mix. Sizes, not texts, go through the flight, so long texts cost what others do. ``mixed`` returns
its own columns only; the caller joins them back by row. The table of sources (one row each) is ordered in one task.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import materialize
from .text import n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 1024


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size): the words each source is to give.

    Sources ordered by code point, null last, weigh `weights` in turn and share `share` of all words. A target stops at
    `most` times its source; the excess is reshared by weight. That is the level t with sum(min(most * size, t * weight))
    = total, found by one pass over the sources ordered by cap / weight.
    """
    one = W.partitionBy(F.lit(0))
    place = F.row_number().over(one.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    by_ratio = one.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(one) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("rest") / F.col("open"))
        .withColumn("full", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct("ratio", "place", "level"))).over(one)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


EDGE = 1e-9


def fly(sizes: list[float], chances: list[float], draw: random.Random) -> list[int]:
    """Move the chances in place until at most two are strictly between 0 and 1; those are returned.

    sum(chances) and sum(chances * sizes) don't change. The direction that keeps both for three documents is the cross product
    of (1, 1, 1) with their sizes; how far it goes either way sets the odds, so that each chance keeps its expectation.
    """
    held: list[int] = []
    for i in range(len(sizes)):
        if not EDGE < chances[i] < 1 - EDGE:
            chances[i] = float(round(chances[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            top = max(map(abs, u))
            u = tuple(x / top for x in u)
            up = min((1 - chances[k]) / x if x > 0 else -chances[k] / x for k, x in zip(held, u, strict=True) if x)
            down = min(chances[k] / x if x > 0 else (chances[k] - 1) / x for k, x in zip(held, u, strict=True) if x)
            step = up if draw.random() * (up + down) < down else -down
            for k, x in zip(held, u, strict=True):
                chances[k] = min(1.0, max(0.0, chances[k] + step * x))
            left = [k for k in held if EDGE < chances[k] < 1 - EDGE]
            if len(left) == 3:  # rounding kept all three inside: settle the nearest
                near = min(held, key=lambda k: min(chances[k], 1 - chances[k]))
                left.remove(near)
            for k in held:
                if k not in left:
                    chances[k] = float(round(chances[k]))
            held = left
    return held


LANDING = 12


def land(sizes: list[float], chances: list[float], left: list[int]) -> None:
    """Give the last documents the 0/1 values whose words, then count, are nearest to what their chances promise."""
    choices = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    s, c = np.array([sizes[k] for k in left]), np.array([chances[k] for k in left])
    off, count = np.abs(choices @ s - c @ s).round(6), np.abs(choices.sum(axis=1) - c.sum()).round(6)
    for k, v in zip(left, choices[np.lexsort((count, off))[0]].tolist(), strict=True):
        chances[k] = float(v)


def _settle(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    source, number, last = key
    block = block.sort_values(["size", "doc_id", "row"], ascending=False, kind="stable")
    sizes, chances = block["size"].astype(float).tolist(), block["chance"].tolist()
    draw = random.Random(zlib.crc32(repr((source, int(number), len(sizes))).encode()))
    # the last block keeps a few documents of all sizes out of the flight, so that the landing can close what the flight leaves
    kept = set(np.linspace(0, len(sizes) - 1, LANDING).astype(int).tolist()) if last else set()
    flying = [i for i in range(len(sizes)) if i not in kept]
    moved = [chances[i] for i in flying]
    left = [flying[i] for i in fly([sizes[i] for i in flying], moved, draw)]
    for i, x in zip(flying, moved, strict=True):
        chances[i] = x
    if last:
        land(sizes, chances, left + [i for i in sorted(kept) if EDGE < chances[i] < 1 - EDGE])
        chances = [float(round(x)) for x in chances]
    return block.assign(chance=chances)[["row", "doc_id", "source", "size", "chance"]]


def cube(docs: DataFrame, block: int = BLOCK) -> Iterator[DataFrame]:
    """Decide rows (row, doc_id, source, size, chance): yields tables that together hold each row once, its chance 0 or 1."""
    spark, level = docs.sparkSession, 0
    while True:
        counts = docs.groupBy("source").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
        numbered = docs.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        numbered = numbered.withColumn("number", F.pmod(F.xxhash64("doc_id", "size", "row", F.lit(level)), F.col("blocks")))
        settled = numbered.groupBy("source", "number", (F.col("blocks") == 1).alias("last")).applyInPandas(_settle, docs.schema)
        settled = materialize(settled, f"cube-{level}")
        yield settled.filter("chance = 0 OR chance = 1")
        docs, level = settled.filter("chance > 0 AND chance < 1"), level + 1
        if docs.isEmpty():
            return


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies): how often each row of docs is taken.

    docs needs doc_id, source, size and row, a number that tells rows apart and isn't null.
    """
    kind = docs.schema["doc_id"].dataType
    docs = materialize(docs.select("row", F.col("doc_id").cast("string"), "source", "size"), "mix")  # pandas would round longs beside nulls
    plan = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = materialize(plan.withColumn("wanted", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "mix-plan")
    joined = docs.join(plan.select(F.col("source").alias("_s"), "wanted"), F.col("source").eqNullSafe(F.col("_s")), "left")
    chances = joined.select("row", "doc_id", "source", "size", (F.col("wanted") - F.floor("wanted")).cast("double").alias("chance"))
    decided = None
    for part in cube(chances):
        decided = part if decided is None else decided.unionByName(part)
    of = plan.select(F.col("source").alias("_s"), "source_size", "target", F.floor("wanted").alias("whole"))
    return decided.join(of, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "row", F.col("doc_id").cast(kind), "source", "size", "source_size", "target", (F.col("whole") + F.col("chance")).cast("long").alias("copies")
    )


def op1_cube_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = F.xxhash64("_metadata.file_name", "_metadata.row_index")
    docs = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row.alias("row"))
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
