"""Points and intervals against any number of ranges (from, to) of any width, both ends included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import few, materialize, sliced

#: Up to so many ranges are sent to all tasks.
BROADCAST_RANGES = 10_000


def _slices(placed: DataFrame, value: Column, carry) -> DataFrame:
    """(_part, _before): carry over what the slices before each one hold. A row a slice."""
    runs = placed.groupBy("_part").agg(value.alias("_v"))
    return runs.select("_part", carry("_v").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))


def merged(ranges: DataFrame) -> DataFrame:
    """Disjoint (from, to) that cover the same as ranges. Ranges without an end, or that end before they start, cover nothing.

    Ranges are ordered in slices: a new one begins where a start lies beyond all ends so far, in its slice and the ones before.
    """
    r = ranges.select("from", "to").filter("from <= to")
    placed = sliced(r, [F.col("from"), F.col("to")], "ranges")
    own = W.partitionBy("_part").orderBy("from", "to")
    ends = placed.join(F.broadcast(_slices(placed, F.max("to"), F.max)), "_part").withColumn("_end", F.max("to").over(own.rowsBetween(W.unboundedPreceding, -1)))
    end = F.greatest("_before", "_end")  # null before the first range
    opened = materialize(ends.select("_part", "from", "to", F.when(F.col("from") <= end, 0).otherwise(1).alias("_new")), "opened")
    numbers = opened.join(F.broadcast(_slices(opened, F.sum("_new"), F.sum)), "_part")
    group = F.coalesce("_before", F.lit(0)) + F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))
    return numbers.withColumn("_group", group).groupBy("_group").agg(F.min("from").alias("from"), F.max("to").alias("to")).select("from", "to")


def outside(rows: DataFrame, ranges: DataFrame, first: str, last: str | None = None, most: int = BROADCAST_RANGES) -> DataFrame:
    """The rows whose [first, last] (or point first) meets no range (from, to). Rows without these stay.

    Few ranges are sent to all tasks. More of them are merged into disjoint ones, and each row looks up the last one that starts by its `last`: of those
    that do, it ends last, so that one alone decides. Rows and starts are ordered together in slices of time, and the slices pass on their last
    range: no key, day or width gathers rows in a task, but for rows of one and the same time.
    """
    last = last or first
    r = ranges.select("from", "to")
    if few(r, most):
        own = r.filter("from <= to").select(F.col("from").alias("_from"), F.col("to").alias("_to"))
        return rows.join(F.broadcast(own), (rows[last] >= own["_from"]) & (rows[first] <= own["_to"]), "left_anti")
    kind = rows.schema[last].dataType
    whole = rows.select(F.struct(*rows.columns).alias("_row"), F.col(last).alias("_at"), F.lit(None).cast(kind).alias("_to"), F.lit(1).alias("_kind"))
    starts = merged(r).select(F.lit(None).cast(whole.schema["_row"].dataType).alias("_row"), F.col("from").cast(kind).alias("_at"), F.col("to").cast(kind).alias("_to"), F.lit(0).alias("_kind"))
    placed = sliced(whole.unionByName(starts), [F.col("_at"), F.col("_kind")], "intervals")
    before = _slices(placed, F.max("_to"), F.max)  # disjoint ranges end in the order they start
    running = W.partitionBy("_part").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = placed.join(F.broadcast(before), "_part").withColumn("_end", F.greatest(F.max("_to").over(running), "_before"))
    return ends.filter((F.col("_kind") == 1) & ~F.coalesce(F.col(f"_row.{first}") <= F.col("_end"), F.lit(False))).select("_row.*")


def outside_by_text(records: DataFrame, ranges: DataFrame, ts: str = "timestamp", most: int = BROADCAST_RANGES) -> DataFrame:
    """Records whose time (a text) lies in no range (from, to: texts). Where a record's time or an end of the range can't be read, their texts are compared instead."""
    read = lambda c: F.try_to_timestamp(F.col(c))
    known = F.col("from").isNotNull() & F.col("to").isNotNull()
    both = read("from").isNotNull() & read("to").isNotNull()
    timed = ranges.filter(both).select(read("from").alias("from"), read("to").alias("to"))
    rows = records.withColumn("_time", read(ts))
    readable = outside(outside(rows.filter("_time IS NOT NULL"), timed, "_time", most=most), ranges.filter(known & ~both), ts, most=most)
    return readable.unionByName(outside(rows.filter("_time IS NULL"), ranges.filter(known), ts, most=most)).drop("_time")
