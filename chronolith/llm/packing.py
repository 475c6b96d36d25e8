r"""Best-fit packing of tokenized documents into sequences, after a dominance reduction (Martello and Toth 1990).

Documents are tokenized inside tasks; only (doc_id, piece, start, length, crc) goes on. How many pieces have each length is a
table of at most `capacity` rows, whatever the corpus: the packing is solved on it, for whole runs of equal sequences at a
time. Which piece gets which place is then a matter of its rank among the pieces of its length, found by `session.ranked`.

Reduction: for the longest length L left, with gap g = capacity - L,
* nothing fits the gap: L alone is fixed;
* some length equals the gap: that pair is fixed;
* two of the shortest pieces overfill the gap: L with the longest piece that fits is fixed;
* three of the shortest overfill it, and no pair that fits is longer than the longest single that fits: the same.
Each of these sets dominates all others that hold L: some optimal packing uses it. It repeats until no length reduces.
Best fit then takes, from the longest length on, whatever leaves the least of each gap.

Null texts are empty texts: one piece, the end token. Long texts are tokenized whole, in one task each. Equal rows and repeated or null ids are separate documents,
numbered by row so that they spread over tasks too. An empty table gives an empty result. Other columns of pieces pass through `packed`.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ranked
from .text import free_name

CAPACITY = 1024
END = 2
#: How byte-level BPE vocabularies of this family part a text before they merge.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_of() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Token ids of a text by a byte-level BPE tokenizer file, as tokenizers gives them without adding special tokens: those that stand in the text become their ids.

    tokenizers reads the file. Where its ids count merges in their order, texts aren't normalised, and the pre-tokenizer is the byte-level one with its own pattern
    (PARTS) and no space put first, tiktoken merges the same vocabulary in half the time; all of that is checked here, and any other tokenizer is used as it is.
    """
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, byte = json.loads(tokenizer.to_str()), _bytes_of()
    special = {t["content"] for t in model["added_tokens"]}
    vocabulary = model["model"]["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["model"]["merges"]]
    parts = model["pre_tokenizer"] or {}
    plain = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
    plain = plain and model["normalizer"] is None and not any(model["model"].get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if plain and all(vocabulary[m] == 256 + i for i, m in enumerate(merged)):
        ranks = {bytes(byte[c] for c in k): v for k, v in vocabulary.items() if k not in special}
        if not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            return functools.partial(tiktoken.Encoding("byte-bpe", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in model["added_tokens"]}).encode, allowed_special="all")
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece of each document (doc_id, text): its place in the document's ids, its length and its ids' CRC-32.

    Documents longer than a sequence are cut into full pieces; what is over comes first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        encode, full = encoder(path), 4 * capacity
        for batch in batches:
            rows = []
            for row, text in enumerate(batch["text"].to_pylist()):
                ids = np.asarray([*encode(text or ""), end], "<u4").tobytes()
                first = len(ids) % full or full
                at, stop, piece = 0, first, 0
                while at < len(ids):
                    rows.append((row, piece, at // 4, (stop - at) // 4, zlib.crc32(ids[at:stop])))
                    at, stop, piece = stop, stop + full, piece + 1
            row, piece, *rest = np.array(rows, np.int64).reshape(-1, 5).T
            columns = [batch["doc_id"].take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, rest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Lengths:
    """A multiset of lengths that answers what the longest one up to a bound is."""

    def __init__(self, counts: dict[int, int]):
        self.counts = Counter({k: v for k, v in counts.items() if v > 0})
        self.order = sorted(self.counts)

    def longest(self, bound: int) -> int:
        at = bisect_right(self.order, bound)
        return self.order[at - 1] if at else 0

    def shortest(self, n: int) -> list[int]:
        out: list[int] = []
        for k in self.order:
            out += [k] * min(self.counts[k], n - len(out))
            if len(out) == n:
                break
        return out

    def best_pair(self, bound: int) -> tuple[int, int]:
        """The two that fill most of the bound together, (0, 0) if no two fit."""
        lo, hi, best = 0, len(self.order) - 1, (0, 0)
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > bound:
                hi -= 1
            else:
                if a + b > sum(best) and (lo != hi or self.counts[a] > 1):
                    best = (b, a)
                lo += 1
        return best

    def take(self, lengths: tuple[int, ...], runs: int) -> None:
        for k, n in Counter(lengths).items():
            self.counts[k] -= n * runs
            if not self.counts[k]:
                del self.counts[k]
                self.order.remove(k)

    def runs(self, lengths: tuple[int, ...]) -> int:
        return min(self.counts[k] // n for k, n in Counter(lengths).items())


def reduce_dominated(left: Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate all others holding their longest length; returns (lengths, how many sequences)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for top in sorted(left.order, reverse=True):
            while left.counts.get(top, 0):
                gap = capacity - top
                rest = Lengths(left.counts - Counter({top: 1}))
                one = rest.longest(gap)
                few = rest.shortest(3)
                dominant = (
                    not one
                    or one == gap
                    or len(few) < 2
                    or few[0] + few[1] > gap
                    or ((len(few) < 3 or sum(few) > gap) and sum(rest.best_pair(gap)) <= one)
                )
                if not dominant:
                    break
                chosen = (top, one) if one else (top,)
                # taking a set makes the shortest pieces no shorter and the best pair no better: it stays dominant while its lengths are there
                runs = left.runs(chosen)
                left.take(chosen, runs)
                fixed.append((chosen, runs))
                changed = True
    return fixed


def best_fit(left: Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fill from the longest length on: a length or pair that closes the gap exactly if there is one, else the longest that fits."""
    packed: list[tuple[tuple[int, ...], int]] = []
    while left.order:
        chosen, used = [left.order[-1]], Counter({left.order[-1]: 1})
        gap = capacity - chosen[0]
        while gap:
            rest = Lengths(left.counts - used) if any(left.counts[k] <= n for k, n in used.items()) else left
            one = rest.longest(gap)
            if not one:
                break
            pair = rest.best_pair(gap) if one != gap else (0, 0)
            step = [x for x in pair if x] if sum(pair) == gap else [one]
            chosen += step
            used.update(step)
            gap -= sum(step)
        if any(left.counts[k] < n for k, n in used.items()):  # a pair of one length with too few left
            used = Counter()
            kept = []
            for k in chosen:
                if left.counts[k] > used[k]:
                    kept.append(k)
                    used[k] += 1
            chosen = kept
        runs = left.runs(tuple(chosen))
        left.take(tuple(chosen), runs)
        packed.append((tuple(chosen), runs))
    return packed


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    left = Lengths(counts)
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs (first rank, sequence of that rank, offset, how many) in order of rank."""
    used: Counter[int] = Counter()
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for lengths, runs in plan:
        offset = 0
        for k in lengths:
            out.setdefault(k, []).append((used[k], sequence, offset, runs))
            used[k] += runs
            offset += k
        sequence += runs
    return out


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (any table with a length column and doc_id, piece) with sequence_id and offset added; columns of these names are replaced."""
    cut = cut.drop("sequence_id", "offset")
    row, place = free_name(cut, "row"), free_name(cut, "rank")
    cut = materialize(cut.withColumn(row, F.monotonically_increasing_id()), "pieces")  # written once: the numbers stay
    ordered = ranked(cut, "length", [F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece"), F.col(row)], "pack", place).drop(row)
    ordered = materialize(ordered, "pack-ranked")
    counts = {r["length"]: r["n"] for r in ordered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = {k: np.asarray(v, "int64") for k, v in places(solve(counts, capacity)).items()}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = np.empty(len(batch), "int64"), np.empty(len(batch), "int64")
            length, rank = batch["length"].to_numpy(), batch[place].to_numpy()
            for k in np.unique(length):
                at, runs = length == k, table[int(k)]
                row = runs[np.searchsorted(runs[:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            kept = batch.drop_columns([place])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    schema = ordered.drop(place).schema.add("sequence_id", "long").add("offset", "long")
    return ordered.mapInArrow(placed, schema)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(pieces(docs))
