r"""Sharding by balanced label propagation.

Documents are linked if their texts are equal (the caller may give any other link key). Each starts in the shard that a hash of
its id names. In each round a document wants the shard where most of its neighbours are; a shard accepts as many linked documents as
its quota leaves and as leave it in the same round, so that full shards exchange documents. Neighbours of one key in one shard are interchangeable, so a round joins and moves
(key, shard, count) cells, not documents: a key that holds a third of all rows is 24 cells, and splits over as
many shards as its rows need. Rounds end when nothing moves any more. Documents without links, and whatever overfills a
shard, then fill the shards' free places in order of key: counts of any two shards differ by one at most.

Law of the query: ``rows``. Null texts are linked to nothing. Equal rows are linked documents like others; null and repeated doc_ids are documents of their own.
Texts, however long, go no further than their link key. An empty table gives an empty result. Other columns of ``sharded`` pass through.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import intermediate_dir, materialize, ranked

SHARDS = 24
#: Rounds end after so many in a row that moved nothing.
IDLE = 4
#: A shard is closed to label moves for a round once it took less than one part in so many of what it was asked for, and no place for
#: large cells to grow while it takes, and has free, less than one part in so many of its room.
NEARLY_FULL = 16


def _unit(*cols) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def accepted(wanted: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The part of what each shard is asked for that it takes: all it has room for once what leaves it has gone.

    wanted[i, j] rows of shard i want shard j. The parts are the largest for which no shard takes more than its free places and those
    that its own rows leave, so full shards exchange rows.
    """
    asked, part = wanted.sum(axis=0), np.ones(len(free))
    for _ in range(10_000):
        less = np.minimum(part, np.clip((free + wanted @ part) / np.maximum(asked, 1), 0, 1))
        if np.abs(less - part).max() < 1e-9:
            break
        part = less
    return less


def propagate(cells: DataFrame, shards: int, room: int) -> DataFrame:
    """Move (key, shard, n) cells towards the shards where most of their key is, no shard ending with more than about room of them.

    Every other round a cell wants the cell of its key that a draw weighted by size names, so that what is stuck finds other ways. Cells
    go whole to any cell of their key and in part to cells not smaller than they are: either makes the sum of squared sizes grow, so
    that moves end. What shards want of each other is a table of shards * shards rows. What a shard can't take in whole it takes in a
    hash-chosen part: small cells move or stay as one, cells of over an eighth of a shard are cut. Keys in one cell are settled and
    leave the rounds.
    """
    spark = cells.sparkSession
    path = f"{intermediate_dir(spark)}/cells-{uuid.uuid4().hex}"
    by_key = W.partitionBy("key")
    cells = cells.select("key", F.col("shard").cast("int").alias("shard"), F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("arrived"))
    settled, closed, full, fresh, idle, number = np.zeros(shards), [], set(), set(), 0, 0
    while True:
        cells = cells.withColumn("whole", F.count("*").over(by_key) == 1)
        cells.write.parquet(f"{path}/round={number}")
        written = spark.read.schema(cells.schema).parquet(f"{path}/round={number}")
        split, arrived = np.zeros(shards), 0
        for r in written.groupBy("shard", "whole").agg(F.sum("n").alias("n"), F.sum("arrived").alias("arrived")).collect():  # two rows a shard
            (settled if r["whole"] else split)[r["shard"]] += r["n"]
            arrived += r["arrived"]
        room_left = room - settled - split
        full -= {s for s in full if room_left[s] * NEARLY_FULL >= room}
        if number and not arrived and not full & fresh:
            idle, full = idle + 1, set()
        elif arrived:
            idle = 0
        if idle == IDLE or not split.any():
            break
        number += 1
        seen = written.filter("NOT whole").select("key", "shard", "n")
        draw = _unit("key", "shard", F.lit(number))
        large = F.col("n") * 8 > room
        size = F.when(large | F.lit(number % 2 == 1), F.col("n") + draw).otherwise(F.col("n") * draw)
        shut = F.col("shard").isin(closed) | (large & F.col("shard").isin(list(full)))
        best = F.max(F.when(~shut, F.struct(size.alias("size"), "shard", "n"))).over(by_key)
        wants = (F.col("best.shard") != F.col("shard")) & (~large | (F.col("n") <= F.col("best.n")))
        asked = seen.withColumn("best", best).select("key", "shard", "n", F.when(wants, F.col("best.shard")).alias("to"))
        wanted = np.zeros((shards, shards))
        for r in asked.filter("to IS NOT NULL").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # shards * shards rows
            wanted[r["shard"], r["to"]] = r["n"]
        part = accepted(wanted, room_left)
        # of a shard that takes next to nothing, cells try their next best in the next round
        closed = [s for s in range(shards) if wanted[:, s].any() and part[s] * NEARLY_FULL < 1]
        fresh = {s for s in range(shards) if part[s] < 1 and part[s] * wanted[:, s].sum() * NEARLY_FULL < room} - full
        full |= fresh
        share = F.array(*[F.lit(float(x)) for x in part])[F.col("to")]
        draw = _unit("key", "shard", F.lit("moves"), F.lit(number))
        cut = F.least(F.col("n"), F.floor(F.col("n") * share + draw))
        moved = F.when(F.col("to").isNull(), 0).when(large, cut).when(draw < share, F.col("n")).otherwise(0).cast("long")
        step = asked.withColumn("moved", moved)
        stay = F.struct("shard", (F.col("n") - F.col("moved")).alias("n"), F.lit(0).cast("long").alias("arrived"))
        go = F.struct(F.col("to").alias("shard"), F.col("moved").alias("n"), F.col("moved").alias("arrived"))
        cells = step.select("key", F.explode(F.array(stay, go)).alias("cell")).select("key", "cell.*").filter("n > 0")
        cells = cells.groupBy("key", "shard").agg(F.sum("n").alias("n"), F.sum("arrived").alias("arrived"))
    done = spark.read.schema(written.withColumn("round", F.lit(0)).schema).parquet(path)
    return done.filter(F.col("whole") | (F.col("round") == number)).select("key", "shard", "n")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (id, key, and any other columns; a null key is linked to nothing) with shard and slot, counts at most one apart.

    Columns named shard or slot are replaced; all others pass through.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    docs = docs.select("id", "key", F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    docs = materialize(docs, "shard-docs")  # written once: the numbers stay
    keys = docs.filter("key IS NOT NULL").groupBy("key", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    keys = materialize(keys, "shard-keys")
    # written, so that joins of documents with it are free to split the rows of one key
    linked = materialize(keys.groupBy("key").agg(F.sum("n").alias("copies")).filter("copies > 1").select("key"), "linked-keys")
    total = docs.count()
    low, more = divmod(total, shards)
    cells = propagate(keys.join(linked, "key", "left_semi"), shards, low + (more > 0))
    # a document of a linked key belongs to the cell that its rank in the key falls into
    bounds = cells.withColumn("hi", F.sum("n").over(W.partitionBy("key").orderBy("shard"))).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("hi", "shard"))).alias("cells"))
    bounds = materialize(bounds, "bounds")  # a row a key, of as many cells as there are shards at most
    in_key = ranked(docs.filter("key IS NOT NULL").join(linked, "key", "left_semi"), "key", [F.col("id"), F.col("row")], "in-key")
    placed = in_key.join(bounds, "key").withColumn("home", F.filter("cells", lambda c: c["hi"] > F.col("rank"))[0]["shard"]).drop("rank", "cells")
    alone = docs.join(linked, "key", "left_anti").withColumn("home", F.lit(shards))
    homes = ranked(placed.select(*docs.columns, "home").unionByName(alone.select(*docs.columns, "home")), "home", [F.col("key"), F.col("id"), F.col("row")], "homes")
    homes = materialize(homes, "homes-ranked")
    # places: shard s has low (+ 1 if s < more) of them; its linked documents take the first, the pool fills the rest
    held = homes.groupBy("home").agg(F.count("*").alias("held"))
    quota = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.lit(low) + (F.col("id") < more).cast("long")).alias("quota"))
    state = quota.join(held.withColumnRenamed("home", "shard"), "shard", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    state = state.withColumn("taken", F.least("held", "quota")).withColumn("open", F.col("quota") - F.col("taken")).withColumn("over", F.col("held") - F.col("taken"))
    first = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    rows = state.withColumn("from", F.coalesce(F.sum("open").over(first), F.lit(0))).withColumn("over_from", F.coalesce(F.sum("over").over(first), F.lit(0)))
    rows = {r["shard"]: r for r in rows.collect()}  # one row a shard
    spilled = sum(r["over"] for r in rows.values())
    table = spark.createDataFrame([(s, r["taken"], r["over_from"]) for s, r in rows.items()] + [(shards, 0, spilled)], "home int, taken long, over_from long")
    slots = F.array(*[F.struct(F.lit(r["from"] + r["open"]).alias("to"), F.lit(s).alias("shard"), F.lit(r["taken"] - r["from"]).alias("shift")) for s, r in sorted(rows.items())])
    pool = homes.join(F.broadcast(table), "home").withColumn("pool", F.when(F.col("rank") >= F.col("taken"), F.col("rank") - F.col("taken") + F.col("over_from")))
    pool = pool.withColumn("into", F.when(F.col("pool").isNotNull(), F.filter(slots, lambda x: x["to"] > F.col("pool"))[0]))
    shard = F.coalesce("into.shard", "home").cast("int").alias("shard")
    return pool.select("doc.*", shard, F.coalesce(F.col("pool") + F.col("into.shift"), F.col("rank")).cast("long").alias("slot"))


def op5_label_propagation(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text", F.octet_length("text"))).alias("key"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharded(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
