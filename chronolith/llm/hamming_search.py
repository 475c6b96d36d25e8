r"""Exact top-k search over binary codes by incremental multi-index hashing (Norouzi, Punjani, Fleet 2012).

A code (the signs of an embedding, of any length) is cut into m segments, each a few bits longer than log2 of the number of codes: shorter ones find codes
sooner, but verify more of them (on 2,000 codes of 64 bits, 52 % with six segments, 29 % with four, in equal time). Steps t = m * a + j
look up, for growing a and j from 0 to m - 1, the codes whose segment j is at exactly a bits from the query's. After step t each code within t
bits of the query has been met: one that has not is over a bits away in segments 0 to j, and a bits or more in all others. What is met is verified, and the search ends
once the kth distance is covered by t.

A look-up goes over the segment values at that distance, or over the values that occur, whichever are fewer; only codes it finds are verified.

Equal codes are one entry with their k + 1 smallest ids, and equal query codes are searched once: vectors with thousands of copies cost
no more than others. The queries (a stated set) meet all codes in blocks: a task holds one part of the codes, with its
tables, and one part of the queries, both of bounded size, and returns the best of its part; the best over all parts are merged.

Ties go to the smaller id. A query is not its own neighbour. Rows with a null id or embedding are left out; null or NaN elements
count as not positive; shorter embeddings than the longest are padded with zeros. Of rows repeated with one id one stays (that of the least code). Empty tables
give empty results. Other columns don't matter.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import materialize

WORD = 64
#: Codes and queries of a block: at least the first, at most the second, in between a 64th of all.
CODES, QUERIES = (1 << 14, 1 << 20), (1 << 9, 1 << 15)


def code(embedding: Column, words: int) -> Column:
    """The signs of an embedding as the bits of so many longs."""
    positive = lambda i: F.coalesce((F.get(embedding, i) > 0) & ~F.isnan(F.get(embedding, i)), F.lit(False))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("long"), lambda a, i: F.when(positive(w * WORD + i), a.bitwiseOR(bit(i))).otherwise(a))
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


@functools.cache
def masks(length: int, radius: int) -> np.ndarray:
    """All segment values of this length with so many bits."""
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(length), radius)], np.int64)


class MultiIndex:
    """Tables of a part of the codes (rows of 64-bit words), one for each segment: the values that occur, and the codes that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes, bits = codes, codes.shape[1] * WORD
        # bits that all codes agree in (padding, say) add the same to each distance: they are no part of a segment
        self.varying = np.bitwise_or.reduce(codes, axis=0) ^ np.bitwise_and.reduce(codes, axis=0)
        places = [i for i in range(bits) if int(self.varying[i // WORD]) >> (i % WORD) & 1] or [0]
        length = min(round(math.log2(max(len(codes), 2))) + 4, 20)
        m = max(1, round(len(places) / length))
        self.segments = [places[j * len(places) // m : (j + 1) * len(places) // m] for j in range(m)]
        self.tables = []
        for segment in self.segments:
            value = self._value(codes, segment)
            order = np.argsort(value, kind="stable")
            known, first = np.unique(value[order], return_index=True)
            self.tables.append((order, known, first, np.diff(np.append(first, len(order)))))

    @staticmethod
    def _value(codes: np.ndarray, places: list[int]) -> np.ndarray:
        """The bits at these places as one number."""
        out = np.zeros(len(codes), np.int64)
        for i, at in enumerate(places):
            out |= ((codes[:, at // WORD] >> np.uint64(at % WORD)) & np.uint64(1)).astype(np.int64) << i
        return out

    def _met(self, value: int, j: int, radius: int) -> np.ndarray:
        """Places of the codes whose segment j is at exactly this distance from the value."""
        order, known, first, many = self.tables[j]
        length = len(self.segments[j])
        if math.comb(length, radius) < len(known):
            wanted = masks(length, radius) ^ value
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            at = at[known[at] == wanted]
        else:
            at = np.flatnonzero(np.bitwise_count(known ^ value) == radius)
        if not len(at):
            return at
        low, n = first[at], many[at]
        return order[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, distances) of the k nearest codes and all that tie with the kth, and how many codes were verified."""
        m, most = len(self.segments), self.codes.shape[1] * WORD
        values = [int(self._value(query[None], places)[0]) for places in self.segments]
        beside = int(np.bitwise_count((query ^ self.codes[0]) & ~self.varying).sum())  # what bits outside the segments add
        fresh = np.ones(len(self.codes), bool)
        places, distances, kth = [], [], most
        for step in range(m * (max(map(len, self.segments)) + 1)):
            radius, j = divmod(step, m)
            met = self._met(values[j], j, radius)
            met = met[fresh[met]]
            if len(met):
                fresh[met] = False
                places.append(met)
                distances.append(np.bitwise_count(self.codes[met] ^ query).sum(axis=1).astype(np.int64))
                have = np.concatenate(distances)
                kth = np.partition(have, k - 1)[k - 1] if len(have) >= k else most
            if kth - beside <= step:
                break
        at, distance = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, distances))
        best = distance <= kth
        return at[best], distance[best], len(at)


def _block(n: int, bounds: tuple[int, int]) -> int:
    """How many blocks n rows make."""
    return max(1, -(-n // min(max(n // 64, bounds[0]), bounds[1])))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) for queries and vectors given as (id, embedding)."""
    known = "id IS NOT NULL AND embedding IS NOT NULL"
    longest = vectors.filter(known).select(F.size("embedding").alias("n")).unionByName(queries.filter(known).select(F.size("embedding").alias("n")))
    words = max(1, -(-(longest.agg(F.max("n")).first()[0] or 0) // WORD))
    coded = lambda df: df.filter(known).select(F.col("id").cast("long"), code(F.col("embedding"), words).alias("code")).groupBy("id").agg(F.min("code").alias("code"))
    by_code = W.partitionBy("code").orderBy("id")
    few = coded(vectors).withColumn("_r", F.row_number().over(by_code)).filter(F.col("_r") <= k + 1)  # limited before the shuffle too
    classes = materialize(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = materialize(coded(queries).withColumnRenamed("id", "query_id"), "queries")
    wanted = asked.select(F.col("code").alias("query")).distinct()
    parts, blocks = _block(classes.count(), CODES), _block(asked.count(), QUERIES)

    index = classes.select("code", F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    probes = wanted.select("query", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "code": [], "distance": []}
        if len(codes) and len(queries):
            values = np.stack(codes["code"].tolist())
            table = MultiIndex(values.view(np.uint64))
            for query in queries["query"].tolist():
                at, distance, _ = table.nearest(query.view(np.uint64), k + 1)
                out["query"] += [query] * len(at)
                out["code"] += list(values[at])
                out["distance"] += distance.tolist()
        return pd.DataFrame(out)

    grouped = index.groupBy("part", "block").cogroup(probes.groupBy("part", "block"))
    met = grouped.applyInPandas(run, "query array<bigint>, code array<bigint>, distance int")
    # of codes that tie, those with the smallest ids count: each stands for its smallest one, then all ids of the best codes compete
    by_query = W.partitionBy("query")
    best = met.join(classes, "code").withColumn("_r", F.row_number().over(by_query.orderBy("distance", F.col("ids")[0]))).filter(F.col("_r") <= k + 1)
    lists = best.select("query", "distance", F.explode("ids").alias("id")).groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, k + 1).alias("best"))
    own = asked.join(lists, asked["code"] == lists["query"]).select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", F.col("b.id").alias("neighbor_id"), F.col("b.distance").alias("distance"), (F.col("at") + 1).alias("rank")
    )


def op9_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return search(rows, rows.filter("id % 20 = 0"))


SQL = """
WITH d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
    CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, neighbor_id, distance, rank FROM r WHERE rank <= 10
"""
