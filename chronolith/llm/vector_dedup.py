"""Near-duplicate vectors by Euclidean p-stable hashing (Datar, Immorlica, Indyk, Mirrokni 2004), verified by exact cosines.

Unit vectors of cosine c are sqrt(2 - 2c) apart. A table has k random projections (components of normal distribution), each shifted at random and cut into cells of
one width; vectors in equal cells of all k share a bucket, the likelier the closer they are. k grows with the logarithm of the number of vectors, so that unrelated ones
rarely meet; the number of tables follows from the chance (MISS) that a pair just at the threshold may meet in none. More similar pairs are missed less often.
Every pair of a bucket is verified by its cosine in double precision; only links at the threshold or above count.

Equal vectors of one label are one class from the start. Classes alone in their buckets never leave the count by bucket. A pair is
counted in the first table whose bucket it shares, so that tasks add up links without writing pairs: what leaves a task is a number and one
edge for each member. Buckets of over `block` classes are cut into blocks, each pair of blocks a group of its own.

Large groups of close copies don't cost all pairs: the mean of a large bucket is a centre, and classes within half the threshold's angle of one centre (a
ball) are linked with each other by the triangle inequality. They are counted by number; only pairs not of one ball are verified.

Rows with a null label take no part, nor do vectors that are null, empty, zero or hold null or non-finite components: they link with nothing and are their own component. Only
vectors of one label and one length are compared. Rows with a null id take part; a component's id is its smallest id (null if it has none), and a
row without id isn't kept. Repeated rows are copies of each other. Empty tables give empty results. Other columns don't matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, shuffle_partitions
from .components import components
from .shingles import mix

THRESHOLD, MISS = 0.98, 1e-3
#: A table is to bring a vector together with so many unrelated ones (at a right angle) at most, on average.
STRAY = 1 / 8
#: Classes of a block. Two blocks' cosines are 32 MB.
BLOCK = 2048


def collision(distance: float, width: float) -> float:
    """The chance that vectors so far apart fall into one cell of a projection."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def tuned(n: int, threshold: float, miss: float) -> tuple[float, int, int]:
    """(width of a cell, projections of a table, tables) for n vectors."""
    near, far = math.sqrt(2 - 2 * threshold), math.sqrt(2)
    cost = lambda w: math.log(collision(near, w)) / math.log(collision(far, w))
    width = min((near * i / 2 for i in range(2, 60)), key=cost)
    k = max(1, math.ceil(math.log(max(n, 2) / STRAY) / -math.log(collision(far, width))))
    return width, k, max(1, math.ceil(math.log(miss) / math.log1p(-(collision(near, width) ** k))))


@functools.lru_cache(maxsize=8)
def _projections(length: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240607, length, rows])
    return rng.standard_normal((length, rows)), rng.random(rows)


def units(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length, scaled to length one. By their largest component first: squares neither overflow nor vanish."""
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signed(rows: DataFrame, width: float, k: int, tables: int) -> DataFrame:
    """rows (cls, label mark, embedding, ...) with the bucket of each table. Buckets of other labels, lengths and tables are other ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths, out = batch["embedding"].map(len).to_numpy(), np.empty(len(batch), object)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                project, shift = _projections(int(length), k * tables)
                cells = np.floor(units(batch["embedding"].iloc[at].tolist()) @ project / width + shift).astype(np.int64).view(np.uint64).reshape(len(at), tables, k)
                mark = mix(batch["mark"].to_numpy()[at].view(np.uint64) ^ mix(np.array([length], np.uint64), 21), 22)
                bucket = mix(mark[:, None] ^ mix(np.arange(tables, dtype=np.uint64), 23), 24)
                for i in range(k):
                    bucket = mix(bucket ^ mix(cells[:, :, i], 25), 26)
                for i, own in zip(at, bucket.view(np.int64), strict=True):
                    out[i] = own
            yield batch.assign(buckets=out)

    return rows.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, buckets array<bigint>")


def balls(classes: DataFrame, buckets: DataFrame, width: float, k: int, tables: int, threshold: float, block: int) -> DataFrame | None:
    """(cls, ball) of the classes within half the threshold's angle of the mean of a bucket of the first table with over `block` classes.

    None if there is no such bucket. A class in reach of several goes to the one with the smallest number.
    """
    hot = buckets.filter(F.col("m") > block).select("bucket")
    first = classes.select("cls", "mark", F.col("buckets")[0].alias("bucket"), "embedding").join(hot, "bucket")
    if first.isEmpty():
        return None
    sums = first.select("bucket", "mark", F.posexplode("embedding").alias("i", "x")).groupBy("bucket", "mark", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = sums.groupBy("bucket", "mark").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))  # a row for each component of a vector
    means = lists.select(F.col("bucket").alias("cls"), "mark", F.transform("v", lambda c: c["x"]).alias("embedding")).filter(F.exists("embedding", lambda x: x != 0))
    centres = materialize(signed(means, width, k, tables), "centres")
    near = centres.select(F.col("cls").alias("ball"), F.explode("buckets").alias("bucket"))
    met = classes.select("cls", F.explode("buckets").alias("bucket")).join(near, "bucket").select("cls", "ball").distinct()
    both = met.join(classes.select("cls", "mark", "embedding"), "cls").join(centres.select(F.col("cls").alias("ball"), F.col("mark").alias("of"), F.col("embedding").alias("centre")), "ball")
    both = both.filter("mark = of").select("cls", "ball", "embedding", "centre")
    reach = math.cos(math.acos(threshold) / 2) + 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            lengths = batch["embedding"].map(len).to_numpy()
            same = lengths == batch["centre"].map(len).to_numpy()
            for length in np.unique(lengths[same]):
                at = np.flatnonzero(same & (lengths == length))
                keep[at] = np.einsum("ij,ij->i", units(batch["embedding"].iloc[at].tolist()), units(batch["centre"].iloc[at].tolist())) >= reach
            yield batch.loc[keep, ["cls", "ball"]]

    return materialize(both.mapInPandas(run, "cls long, ball long").groupBy("cls").agg(F.min("ball").alias("ball")), "balls")


def grouped(met: DataFrame, block: int) -> DataFrame:
    """(g, side, bucket, cls): the groups of classes to compare, of rows (bucket, cls, ball) of shared buckets; ball is 0 for classes of none.

    The classes of a bucket and ball make blocks of about `block`; two blocks make a group (sides 1 and 2), but for two of one ball. A block of no ball is compared with itself, too (side 0).
    """
    kinds = materialize(met.groupBy("bucket", "ball").agg(F.count("*").alias("m"), F.ceil(F.count("*") / block).cast("int").alias("blocks")), "kinds")
    kind = lambda s: kinds.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("ball", "m", "blocks")))
    pairs = kind("a").join(kind("b"), "bucket").filter("ball_a < ball_b OR ball_a = 0 AND ball_b = 0 AND m_a > 1")
    pairs = pairs.withColumn("u_a", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("u_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    pairs = materialize(pairs.filter("ball_a < ball_b OR u_a <= u_b").select("bucket", "ball_a", "u_a", "ball_b", "u_b").withColumn("g", F.monotonically_increasing_id()), "pairs-of-blocks")
    members = met.join(kinds.drop("m"), ["bucket", "ball"]).withColumn("u", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).select("bucket", "ball", "u", "cls")
    two = (F.col("ball_a") != F.col("ball_b")) | (F.col("u_a") != F.col("u_b"))
    side = lambda df, s, n: df.select("bucket", F.col(f"ball_{s}").alias("ball"), F.col(f"u_{s}").alias("u"), "g", n.alias("side"))
    sides = side(pairs, "a", two.cast("int")).unionByName(side(pairs.filter(two), "b", F.lit(2)))
    return members.join(sides, ["bucket", "ball", "u"]).select("g", "side", "bucket", "cls")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place linked with each of n, over pairs (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _linked(side: np.ndarray, bucket: int, vectors: np.ndarray, buckets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places of a group at the threshold or above that share no bucket of an earlier table."""
    alone = bool((side == 0).any())
    left, right = (np.arange(len(side)),) * 2 if alone else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    cosines = vectors[left] @ vectors[right].T
    i, j = np.nonzero(np.triu(cosines >= threshold, 1) if alone else cosines >= threshold)
    a, b = left[i], right[j]
    keep = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 17):
        at = slice(lo, lo + (1 << 17))
        first = (buckets[a[at]] == buckets[b[at]]).argmax(axis=1)
        keep[at] = buckets[a[at], first] == bucket
    return a[keep], b[keep]


def compared(groups: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, links, root): of each group the rows that its members at the threshold link a class with, and the least class it reaches there."""
    rows = groups.join(classes.select("cls", "n", "mark", "embedding", "buckets"), "cls")
    rows = rows.repartition(shuffle_partitions(groups.sparkSession), "g").sortWithinPartitions("g")

    def done(parts: list[pd.DataFrame]) -> pd.DataFrame | None:
        g = parts[0] if len(parts) == 1 else pd.concat(parts)
        lengths, marks = g["embedding"].map(len), g["mark"]
        if lengths.nunique() > 1 or marks.nunique() > 1:  # equal hashes of different labels or lengths
            found = [done([own]) for _, own in g.groupby([lengths, marks])]
            return pd.concat([x for x in found if x is not None]) if any(x is not None for x in found) else None
        side, cls, n = g["side"].to_numpy(), g["cls"].to_numpy(), g["n"].to_numpy()
        if len(g) < 2:
            return None
        a, b = _linked(side, int(g["bucket"].iloc[0]), units(g["embedding"].tolist()), np.stack(g["buckets"].tolist()), threshold)
        if not len(a):
            return None
        links = np.bincount(a, n[b], len(g)) + np.bincount(b, n[a], len(g))
        order = np.argsort(cls)
        place = np.argsort(order)
        root = cls[order][_roots(len(g), place[a], place[b])][place]
        some = links > 0
        return pd.DataFrame({"cls": cls[some], "links": links[some].astype(np.int64), "root": root[some]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            g = batch["g"].to_numpy()
            cuts = np.flatnonzero(np.diff(g, prepend=g[:1] - 1)) if len(g) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(g)], strict=True):
                if held and held[0]["g"].iloc[0] != g[lo]:
                    if (out := done(held)) is not None:
                        yield out
                    held = []
                held.append(batch.iloc[lo:hi])
        if held and (out := done(held)) is not None:
            yield out

    return rows.mapInPandas(run, "cls long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id) of each row of vectors (id, embedding, label): the rows it is linked with, and the smallest id in reach."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.transform("embedding", lambda x: x + F.lit(0).cast("float")).alias("embedding"), "label")  # -0.0 becomes 0.0
    usable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    marks = [F.xxhash64("label", "embedding").alias("h1"), F.hash("embedding", "label").alias("h2")]  # 96 bits tell classes apart when rows are sent to them
    valid = rows.filter(usable).withColumns({"h1": marks[0], "h2": marks[1]})
    classes = valid.groupBy("label", "embedding", "h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("mark", F.xxhash64("label"))
    classes = materialize(classes.select("h1", "h2", "mark", "embedding", "n", "least").withColumn("cls", F.monotonically_increasing_id()), "classes")
    known = classes.select("h1", "h2", "cls")
    members = valid.select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "cls")

    width, k, tables = tuned(classes.count(), threshold, miss)
    classes = materialize(signed(classes.drop("h1", "h2"), width, k, tables), "signed")
    entries = classes.select("cls", F.explode("buckets").alias("bucket"))
    shared = materialize(entries.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "shared")
    in_ball = balls(classes, shared, width, k, tables, threshold, block)
    met = entries.join(shared.select("bucket"), "bucket")
    met = met.withColumn("ball", F.lit(0).cast("long")) if in_ball is None else met.join(in_ball, "cls", "left").withColumn("ball", F.coalesce("ball", F.lit(0)))
    found = materialize(compared(grouped(materialize(met, "met"), block), classes, threshold), "found")

    links, edges = found.select("cls", "links"), found.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))
    if in_ball is not None:
        own = in_ball.join(classes.select("cls", "n"), "cls")
        whole = materialize(own.groupBy("ball").agg(F.sum("n").alias("rows"), F.min("cls").alias("first")), "ball-sizes")
        own = own.join(whole, "ball")
        links = links.unionByName(own.select("cls", (F.col("rows") - F.col("n")).alias("links")))
        edges = edges.unionByName(own.filter("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")))
    reached = components(edges).withColumnRenamed("node", "cls")
    named = classes.select("cls", "n", "least").join(links.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left").join(reached, "cls", "left")
    named = materialize(named.select("cls", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "component").select("cls", "n_links", "component_id"), "component-ids")
    apart = rows.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return members.join(named, "cls").select("id", "n_links", "component_id").unionByName(apart)


def op12_pstable_dedup(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label")
    found = near_duplicates(rows)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
