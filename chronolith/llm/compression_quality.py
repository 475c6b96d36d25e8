r"""Quality by compression: two zstandard dictionaries, built from text labelled good and bad, compress every whole text.

A text is like the class whose dictionary compresses it better. The normalised differences of the two sizes, and how well
either compresses at all (repetition), go through a logistic calibration fitted on labelled rows that built no dictionary:
the score is the chance that the label is 1.

Learning uses a bounded sample of the labelled rows: the ROWS of each class and purpose that come first by hash of doc_id. The texts that build a
dictionary end with the one that reaches CLASS_BYTES; no more than that reaches the driver. The calibration's features are computed in tasks, from whole texts. A row of
the calibration weighs as many labelled rows as it stands for, so that the classes keep their true shares where the sample is smaller than the labels.
Scoring reads every text whole, in tasks, with the two dictionaries (110 KB each), a text at a time, however long it is.

Null and empty texts have features of 0 and get a score like any other. Rows with labels other than 0 and 1, null ids
or null texts teach nothing; of rows with one doc_id the least text does. If a class has no rows, all scores are the share of label 1 (0.5 without any label). Equal texts get equal scores.
Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import materialize

ROWS = 2500
CLASS_BYTES = 6_000_000
DICTIONARY = 112_640
LEVEL = 3
PIECE = 4096


@dataclass
class Model:
    """Two dictionaries and the calibration; `share` alone where there was nothing to learn from."""

    bad: bytes | None
    good: bytes | None
    weights: np.ndarray | None
    mean: np.ndarray | None
    spread: np.ndarray | None
    share: float

    def compressors(self):
        import zstandard

        out = []
        for raw in (self.bad, self.good):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        bad, good = self.compressors()
        out = np.zeros((len(texts), 5))
        for row, text in zip(out, texts, strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if raw:
                b, g, n = len(bad.compress(raw)), len(good.compress(raw)), len(raw)
                row[:] = (b - g) / n, (b - g) / max(b, g), g / n, b / n, np.log(n)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = (self.features(texts) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _dictionary(texts: list[str]) -> bytes | None:
    import zstandard

    pieces, used = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        for i in range(0, len(raw), PIECE):
            if used < CLASS_BYTES:
                pieces.append(raw[i : i + PIECE])
                used += len(pieces[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(used // 8, 256)), pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to find common parts: the text itself is the dictionary
        return b"".join(pieces)[-DICTIONARY:] or None


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weights * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weights * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learned(labelled: DataFrame, docs: DataFrame, rows: int = ROWS) -> Model:
    """From labelled (doc_id, quality) and docs (doc_id, text). Half of the sample builds dictionaries, half calibrates."""
    known = labelled.filter("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    known = known.withColumn("part", F.pmod("h", F.lit(2)).cast("int"))
    found = {(r["quality"], r["part"]): r["n"] for r in known.groupBy("quality", "part").agg(F.count("*").alias("n")).collect()}  # at most 4 rows
    # how many labelled rows a sampled one stands for
    stands = {k: n / min(n, rows) for k, n in found.items()}
    samples = [
        known.filter((F.col("quality") == q) & (F.col("part") == part)).orderBy("h", "doc_id").limit(rows)
        for q in (0, 1)
        for part in (0, 1)
    ]
    wanted = samples[0]
    for s in samples[1:]:
        wanted = wanted.unionByName(s)
    sample = docs.join(F.broadcast(wanted), "doc_id").filter("text IS NOT NULL")  # at most 4 * rows wanted
    sample = materialize(sample.groupBy("doc_id", "h", "quality", "part").agg(F.min("text").alias("text")), "labelled-sample")
    have = {(r["quality"], r["part"]): r["n"] for r in sample.groupBy("quality", "part").agg(F.count("*").alias("n")).collect()}
    of_good = sum(n * stands[k] for k, n in have.items() if k[0] == 1)
    share = float(of_good / sum(n * stands[k] for k, n in have.items())) if have else 0.5
    if len(have) < 4:
        return Model(None, None, None, None, None, share)
    before = F.sum(F.octet_length("text")).over(W.partitionBy("quality").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    building = sample.filter("part = 0").withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < CLASS_BYTES)
    building = building.select("quality", "h", "doc_id", F.substring("text", 1, CLASS_BYTES).alias("text")).orderBy("quality", "h", "doc_id").collect()
    bad, good = (_dictionary([r["text"] for r in building if r["quality"] == q]) for q in (0, 1))
    model = Model(bad, good, None, None, None, share)
    if not (bad and good):
        return model

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": list(model.features(batch["text"].tolist()))})

    rest = sample.filter("part = 1").select("doc_id", F.col("quality").cast("int"), "text").mapInPandas(measured, "doc_id long, quality int, x array<double>")
    rest = rest.orderBy("quality", "doc_id").toPandas()  # at most 2 * rows, of five numbers each
    x, y = np.stack(rest["x"].tolist()), rest["quality"].to_numpy(float)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = np.where(y > 0, stands[1, 1], stands[0, 1])
    model.weights = _logistic((x - model.mean) / model.spread, y, weights / weights.mean())
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(batch["text"].to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op2_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    out = scored(docs, learned(labels, docs))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
