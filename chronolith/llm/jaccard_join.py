r"""N-gram Jaccard join by universe partition and pigeonhole (after PartAlloc: Deng, Li, Wen, Feng, VLDB 2015). Exact.

Sets with Jaccard similarity of 3/4 or more differ in at most (|r| + |s|) / 7 tokens. Sets are put into size bands; the
scheme of a band hashes all tokens into m segments. Two sets that differ in H tokens differ in H segments at most, so
they agree in all but H of the non-empty segments of either. A set is indexed under its own band, and under the band below if it can
have smaller partners there.

* A set with more than H non-empty segments indexes the H + 1 cheapest of them. Cheap is: rare, by a fixed-size table of counts over
  the segments of all documents, then by hash. As both sets follow one order, they share an indexed segment (prefix principle).
* A set with fewer (tiny ones, mostly) indexes all its segments and, for those of two tokens or more, all one-deletion
  neighbours. Segments of one token count 1, others 2: if that sums up to over H, some segment is equal or one token off.
* If even that falls short, the set also indexes its H + 1 tokens of smallest hash; two such sets share one of these.

So every linked pair meets in some index entry, whatever the counts are; counts decide only the cost.

Equal sets are one class from the start. In each entry the classes are compared with one hub, then components are formed, and what
still spans components is compared within tasks, by sizes and parity sketches (which never rule out a link), so that groups of near copies never expand into all pairs. Pairs are
verified on the exact sets of their whole texts.

Null and empty texts have no set and stay alone. Rows with a null doc_id take part; a component's id is its smallest non-null
doc_id. Equal rows and repeated doc_ids are fine. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import materialize, shuffle_partitions
from .components import components
from .shingles import mix, shingle_sets

BUCKETS = 1 << 16
#: Upper ends of the size bands; each is ten times the one before, so that few sets are indexed under two bands.
BANDS = [6]
while BANDS[-1] < 1 << 40:
    BANDS.append(BANDS[-1] * 10)
_TOP = np.array(BANDS, np.int64)


def apart(a, b):
    """The most tokens that linked sets of these sizes differ in."""
    return (a + b) // 7


#: Segments of a scheme for each one that a pair may lose. More of them leave more choice of cheap ones; fewer make each rarer.
CHOICE = 4


def segments_of(band):
    """How many segments a band's scheme has."""
    top = _TOP[band]
    return (apart(top, top * 4 // 3) + 1) * CHOICE + 4


class Entries:
    """Index entries of the sets of one run of texts: arrays over (set, scheme, segment)."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray, n: np.ndarray):
        self.n = n
        start = np.concatenate(([0], np.cumsum(n)[:-1]))
        band = np.searchsorted(_TOP, n, "left")
        below = (band > 0) & (n * 3 <= _TOP[np.maximum(band - 1, 0)] * 4) & (n > 0)
        full = np.flatnonzero(n > 0)
        self.set = np.concatenate((full, np.flatnonzero(below)))
        self.band = np.concatenate((band[full], band[below] - 1))
        partner = np.concatenate((n[full] * 4 // 3, np.minimum(n[below], _TOP[band[below] - 1])))
        self.apart = apart(n[self.set], partner)
        size = n[self.set]
        item = np.repeat(np.arange(len(self.set)), size)
        token = hashes[np.arange(len(item)) + np.repeat(start[self.set] - np.concatenate(([0], np.cumsum(size)[:-1])), size)]
        segment = mix(token, 3) % segments_of(self.band)[item].astype(np.uint64)
        key = (item.astype(np.uint64) << np.uint64(32)) | segment
        order = np.argsort(key, kind="stable")
        key, token = key[order], token[order]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.cut, self.token, self.value = cut, token, mix(token, 4)
        self.item = item[order][cut] if len(key) else np.zeros(0, np.int64)
        self.many = np.diff(np.append(cut, len(key)))
        self.sum = np.add.reduceat(self.value, cut) if len(cut) else np.zeros(0, np.uint64)
        self.place = (self.band[self.item].astype(np.uint64) << np.uint64(40)) | (key[cut] & np.uint64(0xFFFFFFFF))
        self.entry = self.name(self.sum, self.place)

    @staticmethod
    def name(total: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix(total ^ mix(place, 5), 6)

    def counted(self) -> np.ndarray:
        return np.bincount((self.entry % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)

    def chosen(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, entry) of all entries to index."""
        have = np.bincount(self.item, minlength=len(self.set))
        cost = counts[(self.entry % np.uint64(BUCKETS)).astype(np.int64)]
        order = np.lexsort((self.entry, cost, self.item))
        rank = np.arange(len(order)) - np.repeat(np.concatenate(([0], np.cumsum(have)[:-1])), have)
        first = order[rank <= self.apart[self.item[order]]]
        sets, entries = [self.set[self.item[first]]], [self.entry[first]]
        few = have <= self.apart
        if few.any():
            near = np.flatnonzero(few[self.item] & (self.many > 1))
            if len(near):
                at = np.concatenate([np.arange(self.cut[s], self.cut[s] + self.many[s]) for s in near])
                of = np.repeat(near, self.many[near])
                sets.append(self.set[self.item[of]])
                entries.append(self.name(self.sum[of] - self.value[at], self.place[of]))
            worth = np.bincount(self.item, np.minimum(self.many, 2), minlength=len(self.set))
            for i in np.flatnonzero(few & (worth <= self.apart)):
                first_of, past = np.searchsorted(self.item, [i, i + 1])  # the segments of an item lie together, as do their tokens
                own = self.token[self.cut[first_of] : self.cut[past - 1] + self.many[past - 1]]
                least = np.sort(own)[: self.apart[i] + 1]
                sets.append(np.full(len(least), self.set[i]))
                entries.append(mix(least ^ np.uint64(self.band[i] + (1 << 50)), 7))
        return np.concatenate(sets), np.concatenate(entries)


def _classes(hashes: np.ndarray, of: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets and their fingerprints: equal for equal sets only, but for a chance of 2^-64 a pair."""
    n = np.bincount(of, minlength=texts)
    marks = np.zeros(texts, np.uint64)
    full = n > 0
    if full.any():
        starts = np.searchsorted(of, np.flatnonzero(full))
        marks[full] = mix(np.add.reduceat(mix(hashes, 8), starts) ^ mix(n[full].astype(np.uint64), 9), 10)
    return n, marks


def sketch_bits(n: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of a set: the power of two from twice its size on, 64 at least; from 1,024 on, from its size on.

    The share of bits that differ strays less from its mean in large sets, so fewer bits a token tell them apart.
    """
    return 1 << np.ceil(np.log2(np.maximum(np.minimum(2 * n, np.maximum(n, 1024)), 64))).astype(np.int64)


def _sketches(hashes: np.ndarray, of: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Parity sketches: bit i is the parity of how many tokens fall into bucket i. Sets that differ in d tokens differ in d bits at most."""
    out, start = [], 0
    spread = mix(hashes, 11)
    for size, bits in zip(n.tolist(), sketch_bits(n).tolist(), strict=True):
        if not size:
            out.append(np.zeros(0, np.int64))
            continue
        odd = np.bincount((spread[start : start + size] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").view(np.int64))
        start += size
    return out


def profiled(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, class, sketch) of each document, and rows (bucket, count) for the cost of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b, hashes, of in shingle_sets(batch["text"].to_pylist()):
                n, marks = _classes(hashes, of, b - a)
                counts += Entries(hashes, of, n).counted()
                ids, nothing = batch.slice(a, b - a), pa.nulls(b - a)
                sketches = pa.array(_sketches(hashes, of, n), pa.list_(pa.int64()))
                columns = [ids["doc_id"], ids["key"], pa.array(n), pa.array(marks.view(np.int64)), sketches, nothing.cast(pa.int32()), nothing.cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, PROFILE)
        used = np.flatnonzero(counts)
        nothing = [pa.nulls(len(used), t) for t in (*[pa.int64()] * 4, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(used.astype(np.int32)), pa.array(counts[used])], PROFILE)

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n long, class long, sketch array<bigint>, bucket int, count long")


PROFILE = ["doc_id", "key", "n", "class", "sketch", "bucket", "count"]
#: Entries of a bucket that counts so many times the mean, and PART at least, are dealt over several tasks: one for so many.
HOT, PART = 8, 1 << 12


def indexed(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(entry, class, part): the index entries of each class, once for each task that meets it.

    part is 0 but for entries of buckets with a count far above the mean: those are spread over that many parts.
    """
    parts = np.maximum(1, (counts / max(PART, counts.mean() * HOT)).astype(np.int32))
    shared = docs.sparkSession.sparkContext.broadcast((counts, parts))  # 768 KB, whatever the corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, parts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for a, b, hashes, of in shingle_sets(batch["text"].tolist()):
                n, marks = _classes(hashes, of, b - a)
                fresh = np.zeros(b - a, bool)
                for i, m in enumerate(marks.tolist()):
                    if n[i] and m not in seen:
                        seen.add(m)
                        fresh[i] = True
                keep = fresh[of]
                kept = np.where(fresh, n, 0)
                sets, entries = Entries(hashes[keep], of[keep], kept).chosen(counts)
                split = parts[(entries % np.uint64(BUCKETS)).astype(np.int64)]
                part = (mix(marks[sets], 12) % split.astype(np.uint64)).astype(np.int32)
                part = np.where(split > 1, part + 1, 0).astype(np.int32)
                yield pd.DataFrame({"entry": entries.view(np.int64), "class": marks[sets].view(np.int64), "part": part})

    return docs.select("text").mapInPandas(run, "entry long, class long, part int")


def shared_entries(entries: DataFrame) -> DataFrame:
    """(hub, class, more) of the classes that share an entry with a smaller one: hub is the least of the entry, more says whether it has
    three classes or more. An entry that is dealt over parts gets the least of all of them."""
    of_part = W.partitionBy("entry", "part")
    known = entries.dropDuplicates().withColumn("hub", F.min("class").over(of_part)).withColumn("members", F.count("*").over(of_part))
    known = known.filter((F.col("part") > 0) | ((F.col("members") > 1) & (F.col("class") != F.col("hub"))))
    split = F.col("part") > 0
    known = known.select("hub", "class", (F.col("members") > 2).alias("more"), F.when(split, F.col("entry")).alias("of"), F.when(split, F.col("members")).alias("members"))
    known = materialize(known.groupBy("hub", "class", "of", "members").agg(F.max("more").alias("more")), "entries")
    # a split entry: the least of its parts, and how many members it has in all
    spread = known.filter("of IS NOT NULL")
    whole = spread.filter("class = hub").groupBy("of").agg(F.min("hub").alias("hub"), F.sum("members").alias("members")).filter("members > 1")
    spread = spread.select("of", "class").join(materialize(whole, "hot-entries"), "of").filter("class <> hub")
    both = known.filter("of IS NULL").select("hub", "class", "more").unionByName(spread.select("hub", "class", (F.col("members") > 2).alias("more")))
    return both.groupBy("hub", "class").agg(F.max("more").alias("more"))


GROUP = 256
#: Up to so many pairs (some 10 MB) go to the texts by broadcast; beyond it, texts and pairs are shuffled.
BROADCAST_PAIRS = 100_000


def _sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group of rows, which arrive sorted by the keys."""
    held, key = [], None

    def joined() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        own = np.stack([columns[k].astype(np.int64) for k in keys], axis=1)
        start = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(axis=1)))) if len(batch) else []
        for lo, hi in zip(start, [*start[1:], len(batch)], strict=True):
            if held and tuple(own[lo]) != key:
                yield joined()
                held = []
            key = tuple(own[lo])
            held.append({c: v[lo:hi] for c, v in columns.items()})
    if held:
        yield joined()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch (or rows of sketches) of so many words of 64 bits: bit i and bit i + half make one parity. Unsigned, as bits are counted."""
    x = x.view(np.uint64)
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def dealt(pairs: DataFrame) -> DataFrame:
    """(a, g, side, class): for each class a, its partners (side 1) in groups of at most about GROUP, and a itself (side 0) in each of them."""
    many = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "groups")  # a row a class: AQE splits the join's large side
    right = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.col("b").alias("class"))
    left = many.select("a", F.explode(F.sequence(F.lit(0), (F.col("groups") - 1).cast("int"))).alias("g"), F.col("a").alias("class"))
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule a link out: they differ in at most as many bits as linked sets differ in tokens."""
    rows = dealt(pairs).join(sketches, "class").repartition(shuffle_partitions(pairs.sparkSession), "a", "g").sortWithinPartitions("a", "g", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, size = np.zeros(0, np.int64), 0
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (side, n, sketch) in enumerate(zip(batch["side"].tolist(), batch["n"].tolist(), batch["sketch"].tolist(), strict=True)):
                if side == 0:  # the first row of its group
                    hub, size = sketch, n
                else:
                    bits = min(len(hub), len(sketch))
                    keep[i] = np.bitwise_count(_fold(hub, bits) ^ _fold(sketch, bits)).sum() <= (size + n) // 7
            yield batch.loc[keep, ["a", "class"]].set_axis(["a", "b"], axis=1)

    return rows.mapInPandas(run, "a long, b long")


#: Members of one hub are compared in blocks of about this many, each pair of blocks in its own group. A member goes to as many groups
#: as its hub has blocks; a group's sketches are a few megabytes.
BLOCK = 2048


def _crossing(n: np.ndarray, component: np.ndarray, side: np.ndarray, sketches: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of rows in different components, on different sides if there are two, that sizes and sketches don't rule out."""
    size = np.array([len(x) for x in sketches])
    by = {w: np.flatnonzero(size == w) for w in np.unique(size)}
    by = {w: i[np.argsort(n[i], kind="stable")] for w, i in by.items()}
    bits = {w: np.stack([sketches[k] for k in i]).view(np.uint64) for w, i in by.items()}
    two = side.min() != side.max()
    out = []
    for w, own in by.items():
        other = by.get(2 * w)
        small = _fold(bits[2 * w], w) if other is not None else None
        for at, i in enumerate(own):
            for where, rows, start in ((own, bits[w], at + 1), (other, small, 0)):
                if where is None:
                    continue
                stop = np.searchsorted(n[where], n[i] * 4 // 3, "right")
                low = max(start, np.searchsorted(n[where], -(-n[i] * 3 // 4), "left"))
                if low >= stop:
                    continue
                j = where[low:stop]
                keep = component[j] != component[i]
                if two:
                    keep &= side[j] != side[i]
                if not keep.any():
                    continue
                differ = np.bitwise_count(rows[low:stop][keep] ^ bits[w][at]).sum(axis=1)
                j = j[keep]
                out += [(i, k) for k in j[differ <= (n[j] + n[i]) // 7]]
    return out


def crossing(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (hub, class, component) of one hub, in different components, that sizes and sketches don't rule out.

    Compared in memory, block against block; only what passes leaves the task.
    """
    parts = shuffle_partitions(members.sparkSession)
    many = materialize(members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "hubs")
    rows = members.join(many, "hub").withColumn("u", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.join(sketches, "class").withColumn("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("hub", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), "u", "class", "component", "n", "sketch")
    rows = rows.repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _sorted_groups(batches, ["hub", "i", "j"]):
            if g["component"].min() == g["component"].max():
                continue
            classes = g["class"]
            found = _crossing(g["n"], g["component"], g["u"], list(g["sketch"]))
            pairs = [(min(classes[a], classes[b]), max(classes[a], classes[b])) for a, b in found]
            if pairs:
                yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(run, "a long, b long").distinct()


def verified(docs: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of the pairs of classes whose sets have a similarity of 3/4 or more.

    first has (class, key): one document of each class, by doc_id or, where that is null, by a hash of its text.
    Callers leave out pairs that their sketches rule out: those never see a text. Texts travel to the pairs of class a, in groups of at
    most GROUP partners, so that a class with many partners is spread over tasks; each text of a comes along once a group.
    """
    pairs = materialize(pairs, "pairs")
    wanted = dealt(pairs).join(first.select("class", "key"), "class")
    if pairs.count() <= BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)
    sent = docs.select("key", "text").join(wanted, "key").select("a", "g", "side", "class", "text")
    sent = sent.repartition(shuffle_partitions(docs.sparkSession), "a", "g").sortWithinPartitions("a", "g", "side", "class")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = list(batch[["a", "g", "side", "class"]].itertuples(index=False, name=None))
            out = []
            for start, stop, hashes, of in shingle_sets(batch["text"].tolist()):
                n, marks = _classes(hashes, of, stop - start)
                at = np.searchsorted(of, np.arange(stop - start + 1))
                for i in range(stop - start):
                    a, g, side, mark = rows[start + i]
                    if int(marks[i : i + 1].view(np.int64)[0]) != mark:
                        continue  # another text under the same key
                    own = hashes[at[i] : at[i + 1]]
                    if side == 0:
                        key, hub = (a, g), own
                    elif key == (a, g):
                        both = np.count_nonzero(hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own)
                        if 4 * both >= 3 * (len(own) + len(hub) - both):
                            out.append((a, mark))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sent.mapInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text)."""
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), "text", F.coalesce(doc_id, F.xxhash64("text")).alias("key"))
    both = materialize(profiled(docs), "profiles")
    profiles = both.filter("n > 0").select("doc_id", "key", "n", "class")
    counts = np.zeros(BUCKETS, np.int64)
    for r in both.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("c")).collect():  # BUCKETS rows at most
        counts[r["bucket"]] = r["c"]
    first = materialize(profiles.groupBy("class").agg(F.min("key").alias("key"), F.min("doc_id").alias("least"), F.max("n").alias("n")), "classes")
    sketches = both.filter("n > 0").select("class", "n", "sketch").dropDuplicates(["class"])  # equal sets have equal sketches

    pairs = materialize(shared_entries(indexed(docs, counts).repartition(shuffle_partitions(docs.sparkSession), "entry", "part")), "shared")
    size = lambda name, n: first.select(F.col("class").alias(name), F.col("n").alias(n))
    sized = pairs.select(F.col("hub").alias("a"), F.col("class").alias("b")).join(size("a", "an"), "a").join(size("b", "bn"), "b")
    star = materialize(sized.filter("an * 4 >= bn * 3 AND bn * 4 >= an * 3").select("a", "b"), "star")
    edges = materialize(verified(docs, first, plausible(star, sketches)), "links")
    found = components(edges)

    # hubs whose other members (in entries of three classes or more) still span components: those members are compared across components
    # (a class without a link is its own component); pairs with the hub are known
    labelled = pairs.filter("more").select("hub", "class").join(found.withColumnRenamed("node", "class"), "class", "left")
    labelled = materialize(labelled.withColumn("component", F.coalesce("component", "class")), "labelled")
    spans = labelled.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("hub")
    members = materialize(labelled.join(materialize(spans, "spans"), "hub"), "members")
    more = verified(docs, first, crossing(members, sketches))
    found = components(edges.unionByName(more))

    # the least doc_id of a class, then of its component, then back: one row a class, in joins whose large side AQE may split
    classed = materialize(first.select("class", "least").join(found.withColumnRenamed("node", "class"), "class", "left"), "classed")
    least = classed.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("all"))
    least = materialize(least, "component-ids")
    named = classed.join(least, "component", "left").select("class", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("all")).alias("component_id"))
    named = materialize(named, "class-ids")
    linked = profiles.join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(both.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op10_partition_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
