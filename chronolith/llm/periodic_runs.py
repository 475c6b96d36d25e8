r"""Periodic runs in the word sequences of whole texts, by harmonic grid probing.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least max(6, 4 * q) that no neighbouring
word extends keeping period q. Whatever holds 4 * p words holds four multiples of p in a row, jp to (j + 3)p, and words with period p are equal there.
So for each p the words at jp and (j + 1)p are compared, n / p of them: n * log n in all. Where three neighbours on the grid are equal in a row, the
stretch is extended both ways by comparing chunks of the array with the same chunks p words on. Grid points inside a found run whose period
divides p are skipped: what is there has that shorter period.

Short periods are probed one by one over the whole grid, long ones (few grid points each) many at a time, one grid step after the other. Texts are
joined by marks that equal no word, so that one pass serves many texts; a text of any length is one array of integers.

Words are `[^\x20\x09-\x0D]+`. Null and empty texts have no words and no runs. Null ids, repeated ids and rows are fine: each row is judged by itself. An
empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import let, words

#: A run has so many periods, and so many words, at least.
PERIODS, WORDS = 4, 6
#: So many words make a pass (a longer text is a pass of its own).
PASS = 1 << 18


def _extent(ids: np.ndarray, x: int, p: int) -> tuple[int, int]:
    """The longest stretch (start, end) around x, where ids[x] = ids[x + p], in which words p apart are identical."""
    right, chunk, top = x, 64, len(ids) - p
    while right < top:
        stop = min(right + chunk, top)
        differ = ids[right:stop] != ids[right + p : stop + p]
        at = int(differ.argmax())
        if differ[at]:
            right += at
            break
        right, chunk = stop, min(2 * chunk, 1 << 16)
    left, chunk = x, 64
    while left > 0:
        stop = max(left - chunk, 0)
        differ = (ids[stop:left] != ids[stop + p : left + p])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            left -= at
            break
        left, chunk = stop, min(2 * chunk, 1 << 16)
    return left, right + p


class _Found:
    """Starts and ends of runs by period, in order."""

    def __init__(self):
        self.by_period: dict[int, np.ndarray] = {}

    def outside(self, at: np.ndarray, p: int) -> np.ndarray:
        """Those grid points of which no run with a period that divides p holds the next one too: a stretch of period p there has that shorter one."""
        for q, runs in self.by_period.items():
            if p % q == 0 and len(at):
                i = np.searchsorted(runs[:, 0], at, "right") - 1
                at = at[(i < 0) | (runs[np.maximum(i, 0), 1] <= at + p)]
        return at

    def probe(self, ids: np.ndarray, at: np.ndarray, p: int) -> None:
        """Extend the survivors of period p, given in order: grid points that equal the next three. Some words between these are compared first."""
        own, past, at = [], 0, self.outside(at, p)
        for off in (p // 2, p + p // 2, 1, p - 1, p + 1, 2 * p - 1):
            if p > 1 and len(at):
                at = at[ids[at + off] == ids[at + off + p]]
        for x in at.tolist():
            if x + p < past:  # in the stretch just looked at
                continue
            start, past = _extent(ids, x, p)
            if past - start >= max(WORDS, PERIODS * p):
                own.append((start, past))
        if own:
            self.by_period[p] = np.array(own)


def runs_of(ids: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array whose texts are no longer than that."""
    found, top = _Found(), longest // PERIODS
    few = min(top, max(1, int(np.sqrt(len(ids)))))
    for p in range(1, few + 1):  # many grid points
        grid = ids[::p]
        same = grid[1:] == grid[:-1]
        if len(same) >= 3:
            at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2]) * p
            if len(at):
                found.probe(ids, at, p)
    survivors = []
    for j in range(len(ids) // (few + 1) - 2):  # few grid points for each of many periods
        p = np.arange(few + 1, min(top, (len(ids) - 1) // (j + 3)) + 1)
        word = ids[j * p]
        p = p[word == ids[(j + 1) * p]]
        p = p[ids[(j + 1) * p] == ids[(j + 2) * p]]
        p = p[ids[(j + 2) * p] == ids[(j + 3) * p]]
        survivors.append(np.stack((p, j * p), axis=1))
    if survivors and len(both := np.concatenate(survivors)):
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        cuts = np.flatnonzero(np.diff(both[:, 0], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(both)], strict=True):
            found.probe(ids, both[lo:hi, 1], int(both[lo, 0]))
    for p, runs in found.by_period.items():
        yield from ((start, end - start, p) for start, end in runs.tolist())


def _examined(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each list of words its runs, rows (start, length, period) in order of start and period, and which words stay without repetitions."""
    many = np.array([len(t) for t in texts])
    number = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(many.sum()))
    first = np.concatenate(([0], np.cumsum(many)))
    joined = np.empty(len(ids) + len(texts), np.int64)  # each text is followed by a mark of its own
    owner = np.repeat(np.arange(len(texts)), many)
    joined[np.arange(len(ids)) + owner] = ids
    joined[first[1:] + np.arange(len(texts))] = -1 - np.arange(len(texts))
    rows = np.array(sorted(runs_of(joined, int(many.max(initial=0))), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    starts = first[:-1] + np.arange(len(texts))
    cut = np.searchsorted(rows[:, 0], np.append(starts, len(joined)))
    out = []
    for i, n in enumerate(many.tolist()):
        own = rows[cut[i] : cut[i + 1]] - [starts[i], 0, 0]
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, own[:, 0] + own[:, 2], 1)
        np.add.at(change, own[:, 0] + own[:, 1], -1)
        out.append((own, np.cumsum(change[:n]) == 0))
    return out


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of each row: its runs by start, then period, and its words joined by one space without those that a run repeats.

    A word goes if a run holds it after that run's first period.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def examined(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = _examined(texts)
        sizes = np.concatenate(([0], np.cumsum([len(runs) for runs, _ in found])))
        rows = np.concatenate([runs for runs, _ in found])
        struct = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(run_type.value_type))
        kept = [b" ".join(words if stay.all() else itertools.compress(words, stay)) for words, (_, stay) in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(keys), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct).cast(run_type), pa.array(kept, pa.binary())],
            ["key", "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for i in range(batch.num_rows):
                own = (batch["text"][i].as_py() or b"").split()  # the white space of bytes is that of the words
                if texts and size + len(own) > PASS:
                    yield examined(keys, texts)
                    keys, texts, size = [], [], 0
                keys.append(batch["key"].slice(i, 1))
                texts.append(own)
                size += len(own)
            if texts:
                yield examined(keys, texts)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of one document in ten with a tail that repeats from a place on, both by the checksum of its id.

    Documents without an id and texts without words stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(own: Column) -> Column:
        n = F.size(own).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        return let(F.struct(own.alias("w"), a.alias("a"), p.alias("p")), lambda v: F.array_join(
            F.concat(F.slice(v["w"], 1, v["a"].cast("int")), F.transform(F.sequence(v["a"], n - 1), lambda i: F.get(v["w"], (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))), " "
        ))

    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words(text), repeated)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """n_runs, the run of the greatest exponent, and checksums of all runs and of the collapsed text, beside the doc_id of each row.

    Of runs with equal exponents the one with the smallest start, then period, counts; without a run its four columns are null.
    """
    better = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(better(r, a), r).otherwise(a))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
