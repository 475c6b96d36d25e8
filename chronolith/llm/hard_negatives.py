"""Hard negatives by a vantage-point tree over norm-augmented vectors (after Yianilos 1993; augmentation as in Bachrach et al. 2014).

Vectors of integers get one more component, the square root of M^2 - |x|^2, where M is the largest length of all: then all are M long, and the squared distance of an
anchor (with a zero there) is |a|^2 + M^2 - 2 * score, score being the inner product. Higher scores are nearer, and a window of scores is an annulus of distances.

The first levels part the rows by label. Below, a node of the tree has a vantage point and two halves, nearer and farther rows, with the least and the greatest distance of each from that point. By the triangle inequality these bound
the distances from an anchor. Nodes are visited nearest first; those outside the annuli still open, or with no row of the labels wanted, are left out. A search ends
once the kth row of each window is nearer than the nearest node left. Scores are exact integers; floating-point bounds are widened by more than their error.

Rows with equal vectors and labels are one entry with their smallest ids, and equal anchors are searched once, so copies cost no more than others. The
anchors (a stated set) meet all entries in blocks: a task holds a tree over one part of the entries and one part of the anchors, both of bounded size, and returns the
best of its part (of rows that tie, those with the smallest ids). Positives come first; their scores give the windows of the second search.

Ties go to the smaller id. Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors are padded
with zeros. Of rows repeated with one id and label and vector one stays. Scores must fit 53 bits (components of 2^23 in 128 dimensions): an error says so otherwise.
Anchors without another row of their label have no rows in the result. Empty tables give empty results. Other columns don't matter.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import materialize

LEAF = 1024
#: Entries of a part of at most this many bytes; anchors of a block: at least the first, at most the second, in between a 16th of all.
PART_BYTES, ANCHORS = 1 << 25, (1 << 8, 1 << 14)


class VantageTree:
    """Rows (vectors of integers as doubles, label numbers, smallest ids) under a bound M on their lengths, put in the order of the leaves."""

    def __init__(self, x: np.ndarray, label: np.ndarray, least: np.ndarray, longest: float):
        extra = np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0))
        far = lambda rows, v: np.sqrt(((x[rows] - x[v]) ** 2).sum(axis=1) + (extra[rows] - extra[v]) ** 2)
        #: [nearer child, farther child, vantage point (vector and last component; None: parted by label), (least, greatest) distance of each half, first row, past the last, least and greatest label]
        self.nodes: list[list] = []
        order, stack = np.argsort(label, kind="stable"), [(0, len(x), -1, 0)]
        while stack:
            lo, hi, parent, half = stack.pop()
            rows, number = order[lo:hi], len(self.nodes)
            if parent >= 0:
                self.nodes[parent][half] = number
            own = label[rows]
            node = [-1, -1, None, ((0.0, math.inf),) * 2, lo, hi, int(own.min()), int(own.max())]
            self.nodes.append(node)
            if hi - lo <= LEAF and (node[6] == node[7] or hi - lo <= LEAF // 8):
                continue
            if node[6] < node[7]:
                at = np.flatnonzero(own[1:] != own[:-1]) + 1  # in order of labels here
                mid = int(at[np.abs(at - (hi - lo) / 2).argmin()])
            else:
                vantage = rows[far(rows, rows[0]).argmax()]  # at the rim, where distances spread
                away = far(rows, vantage)
                by = np.argsort(away, kind="stable")
                order[lo:hi], away = rows[by], away[by]
                mid = (hi - lo) // 2  # halves of rows, not of distances: equal rows make no deep tree
                node[2:4] = (x[vantage], extra[vantage]), ((away[0], away[mid - 1]), (away[mid], away[-1]))
            stack += [(lo + mid, hi, number, 1), (lo, lo + mid, number, 0)]
        self.x, self.label, self.least, self.order, self.longest = x[order], label[order], least[order], order, longest

    def nearest(self, a: np.ndarray, own: int, same: bool, windows: np.ndarray, k: int) -> tuple[list[list[tuple[int, int, int]]], int]:
        """The k best rows of each window (lo, hi) of scores, as (-score, smallest id, row), of those whose label is (same) or isn't the anchor's own; and how many rows were scored."""
        base = float(a @ a) + self.longest**2
        slack = 1e-6 * math.sqrt(base)
        distance = lambda score: math.sqrt(max(base - 2 * score, 0.0))
        inner, outer = ([distance(float(w[i])) for w in windows] for i in (1, 0))  # the outer one comes nearer as rows are found
        least = [float(w[0]) for w in windows]
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        heap, scored = [(0.0, math.inf, 0)] if len(windows) else [], 0
        while heap:
            low, high, number = heapq.heappop(heap)
            if low > max(outer) + slack:
                break
            near, far, vantage, halves, lo, hi, first, last = self.nodes[number]
            if (own < first or own > last) if same else first == last == own:
                continue
            wanted = [w for w in range(len(windows)) if low <= outer[w] + slack and high >= inner[w] - slack]
            if not wanted:
                continue
            if near < 0:
                scores, scored = self.x[lo:hi] @ a, scored + hi - lo  # exact: integers below 2^53
                at = np.flatnonzero((scores >= min(least[w] for w in wanted)) & (scores <= max(windows[w, 1] for w in wanted)))
                if first != last:
                    at = at[(self.label[lo:hi][at] == own) == same]
                scores = scores[at]
                for w in wanted if len(at) else ():
                    fit = (scores >= least[w]) & (scores <= windows[w, 1])
                    if fit.any():
                        rows = zip((-scores[fit]).astype(np.int64).tolist(), self.least[lo:hi][at[fit]].tolist(), (at[fit] + lo).tolist(), strict=True)
                        found[w] = heapq.nsmallest(k, itertools.chain(found[w], rows))
                        if len(found[w]) == k:
                            least[w] = -found[w][-1][0]
                            outer[w] = distance(least[w])
                continue
            away = 0.0
            if vantage is not None:
                gap = a - vantage[0]
                away = math.sqrt(float(gap @ gap) + float(vantage[1]) ** 2)
            for child, (nearest, farthest) in zip((near, far), halves, strict=True):
                heapq.heappush(heap, (max(low, nearest - away, away - farthest), min(high, away + farthest), child))
        return found, scored


def _searched(entries: DataFrame, anchors: DataFrame, length: int, longest: float, same: bool, k: int, parts: int, blocks: int) -> DataFrame:
    """(anchor, of, score, entry): the k best entries of each part for each window (of, lo, hi) of anchors (anchor, label, x, windows)."""
    index = entries.select("entry", "label", "x", F.col("ids")[0].alias("least"), F.pmod(F.xxhash64("entry"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = anchors.select("anchor", "label", "x", "windows", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def matrix(lists: pd.Series) -> np.ndarray:
        out = np.zeros((len(lists), length))
        for i, x in enumerate(lists):
            out[i, : len(x)] = x
        return out

    def run(entries: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(anchors):
            tree = VantageTree(matrix(entries["x"]), entries["label"].to_numpy(), entries["least"].to_numpy(), longest)
            names = entries["entry"].to_numpy()[tree.order]
            for anchor, own, a, windows in zip(anchors["anchor"].tolist(), anchors["label"].tolist(), matrix(anchors["x"]), anchors["windows"], strict=True):
                bounds = np.array([(w["lo"], w["hi"]) for w in windows], np.float64).reshape(-1, 2)
                found, _ = tree.nearest(a, own, same, bounds, k)
                out += [(anchor, int(window["of"]), -minus, int(names[row])) for window, best in zip(windows, found, strict=True) for minus, _, row in best]
        return pd.DataFrame(out, columns=["anchor", "of", "score", "entry"])

    return index.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(run, "anchor long, of long, score long, entry long")


def _best(met: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(anchor, of, best): the k best rows (score, id) of each anchor and window, of all rows that the best entries stand for."""
    by = W.partitionBy("anchor", "of")
    few = met.join(classes.select("entry", "ids"), "entry").withColumn("_r", F.row_number().over(by.orderBy(F.desc("score"), F.col("ids")[0]))).filter(F.col("_r") <= k)
    rows = few.select("anchor", "of", "score", F.explode("ids").alias("id")).groupBy("anchor", "of")
    return rows.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))), 1, k).alias("best"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label long, x array<bigint>), anchors being those where is_anchor holds.

    An anchor's positives are its best other rows of the same label. For each of them the best rows of other labels count whose score is from low to high
    hundredths of the positive's.
    """
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "x", is_anchor.alias("asked"))
    keep = max(positives + 1, negatives)
    by = W.partitionBy("label", "x").orderBy("id")
    few = rows.select("label", "x", "id").distinct().withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= keep)  # limited before the shuffle too
    classes = few.groupBy("label", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.withColumn("entry", F.monotonically_increasing_id()), "entries")
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("length"), F.max(square).alias("square")).first()
    if (size["square"] or 0) * 4 >= 1 << 53:
        raise ValueError("scores of these vectors need over 53 bits")
    length, longest = max(size["length"] or 1, 1), math.sqrt(size["square"] or 0.0)
    asked = materialize(rows.filter("asked").select("id", "label", "x").join(classes.select("label", "x", "entry"), ["label", "x"]).select("id", "label", "x", F.col("entry").alias("anchor")).distinct(), "anchors")
    queries = asked.select("anchor", "label", "x").dropDuplicates(["anchor"])
    parts = max(1, -(-size["n"] // max(LEAF, min(max(size["n"] // 16, 1 << 10), PART_BYTES // (8 * length)))))
    blocks = max(1, -(-queries.count() // min(max(size["n"] // 16, ANCHORS[0]), ANCHORS[1])))

    everything = F.array(F.struct(F.lit(0).cast("long").alias("of"), F.lit(-(1 << 53)).cast("long").alias("lo"), F.lit(1 << 53).cast("long").alias("hi")))
    near = materialize(_best(_searched(classes, queries.withColumn("windows", everything), length, longest, True, positives + 1, parts, blocks), classes, positives + 1), "positives")
    own = asked.select("anchor", F.col("id").alias("anchor_id")).join(near.select("anchor", "best"), "anchor")
    own = own.select("anchor", "anchor_id", F.explode(F.slice(F.filter("best", lambda b: b["id"] != F.col("anchor_id")), 1, positives)).alias("b"))
    pairs = materialize(own.select("anchor", "anchor_id", F.col("b.id").alias("positive_id"), (-F.col("b.minus")).alias("positive_score")), "anchors-positives")

    whole = lambda v: F.expr(f"(({v}) - pmod({v}, 100)) div 100")  # noqa: E731  rounded down
    window = F.struct(F.col("positive_score").alias("of"), (-whole(f"positive_score * {-low}")).alias("lo"), whole(f"positive_score * {high}").alias("hi"))
    windows = pairs.select("anchor", window.alias("w")).filter("w.lo <= w.hi").groupBy("anchor").agg(F.collect_set("w").alias("windows"))
    hard = _best(_searched(classes, queries.join(windows, "anchor"), length, longest, False, negatives, parts, blocks), classes, negatives)
    ranked = hard.select("anchor", F.col("of").alias("positive_score"), F.posexplode("best").alias("at", "b"))
    return pairs.join(ranked, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("negative_id"), "positive_score", (-F.col("b.minus")).alias("negative_score")
    )


def op13_vantage_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    label = F.when(F.pmod("id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(rows.filter(finite).select("id", label.alias("label"), whole.alias("x")), F.col("id") % 50 == 0)


#: Checks the same from its definition, by all scores.
SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
