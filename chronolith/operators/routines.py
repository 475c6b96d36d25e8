"""Routines, briefings, file questions, memory and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions.text import ascii_tokens, lines, parted, redact_secrets, token_list, tokens, truncated
from ..functions.values import ratio
from ..session import sliced


def latest_runs(definitions: DataFrame, runs: DataFrame) -> DataFrame:
    """Each definition with its newest run, if any; by name."""
    last = runs.groupBy("name").agg(F.max_by(F.struct("run_id", "status", "started_at"), F.struct("started_at", "run_id")).alias("last"))
    return definitions.join(last, "name", "left").select(*definitions.columns, F.col("last.run_id").alias("last_run_id"), F.col("last.status").alias("last_status")).orderBy("name")


def history(runs: DataFrame, name: str, limit: int) -> DataFrame:
    return runs.filter(F.col("name") == name).orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def defined(definitions: DataFrame, row: DataFrame) -> DataFrame:
    """definitions with row put in by name; the first creation time stays."""
    old = definitions.select("name", F.col("created_at").alias("_created"))
    new = row.join(old, "name", "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    return definitions.join(row.select("name"), "name", "left_anti").unionByName(new)


def briefing_evidence(hits: DataFrame, text: str = "extracted_text", size: int = 120, limit: int = 10) -> DataFrame:
    """The newest distinct texts, redacted and cut: what a briefing shows. The first frame of a text by recency stands for it."""
    best = hits.groupBy(text).agg(F.max(F.struct("frame_timestamp", "frame_id", "app_name")).alias("f")).select(F.col(text), "f.*")
    shown = best.orderBy(F.desc("frame_timestamp"), F.desc("frame_id")).limit(limit)
    return shown.withColumn(text, truncated(redact_secrets(F.col(text)), size))


def file_lines(files: DataFrame) -> DataFrame:
    """(key, line_number from 1, line) of files (key, text)."""
    return files.select("key", F.posexplode(lines(F.col("text"))).alias("_n", "line")).select("key", (F.col("_n") + 1).alias("line_number"), "line")


def evidence_lines(file_rows: DataFrame, question: str, limit: int = 5, ascii_only: bool = False) -> DataFrame:
    """The lines that share most distinct tokens with a question, by score then place. Only lines that hold a token's letters at all are cut into tokens."""
    asked = token_list(question, question=True)
    if not asked:
        return file_rows.withColumn("score", F.lit(0)).limit(0)
    own = ascii_tokens(F.col("line")) if ascii_only else tokens(F.col("line"))
    score = F.size(F.array_intersect(own, F.array(*[F.lit(t) for t in asked])))
    met = reduce(lambda a, b: a | b, [F.col("_parted").contains(t) for t in asked])
    scored = file_rows.withColumn("_parted", parted(F.col("line"))).withColumn("score", F.when(met, score).otherwise(0)).drop("_parted")
    return scored.filter("score > 0").orderBy(F.desc("score"), "key", "line_number").limit(limit)


def highlights(files: DataFrame, limit: int = 3) -> DataFrame:
    """The first lines of each file (key, text) that aren't blank; files without any are left out."""
    kept = F.filter(F.transform(lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != "")
    return files.select("key", F.slice(kept, 1, limit).alias("highlights")).filter(F.size("highlights") > 0)


def memory_written(memory: DataFrame, scope: str, text: str, append: bool = True) -> DataFrame:
    """memory (scope, content) with text appended after a blank line, or in place of what was there."""
    old = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", F.lit(None)).otherwise(F.col("content"))
    new = F.concat_ws("\n\n", old, F.lit(text)) if append else F.lit(text)
    return memory.withColumn("content", F.when(F.col("scope") == scope, new).otherwise(F.col("content")))


def source_stats(rows: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """Files and sums by each of the groups (module, language, directory) and over all, in one pass."""
    return rows.groupingSets([[g] for g in groups] + [[]], *groups).agg(F.grouping_id().alias("grouping"), F.count("*").alias("files"), *[F.sum(c).alias(c) for c in sums])


def largest_sources(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The files (path, code) with most code."""
    return rows.orderBy(F.desc("code"), "path").limit(limit)


# What can be asked about, and how large it may be.
TEXT_EXTENSIONS = ".ts .tsx .js .jsx .json .yaml .yml .md .txt .mjs .cjs .css .html .xml".split()
MOST_BYTES = 1_048_576


def file_error(files: DataFrame, roots: list[str], extensions: list[str] = TEXT_EXTENSIONS, most: int = MOST_BYTES) -> DataFrame:
    """files (path, kind: file, directory or null where there is none; length, content) with the first thing that speaks against reading them, if any."""
    root = F.lit(False)
    for r in roots:
        root = root | (F.col("path") == r.rstrip("/")) | F.col("path").startswith(r.rstrip("/") + "/")
    extension = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    error = (
        F.when(F.col("kind").isNull(), "FILE_NOT_FOUND").when(F.col("kind") == "directory", "PATH_IS_DIRECTORY").when(~root, "PATH_NOT_ALLOWED").when(F.col("length") > most, "FILE_TOO_LARGE")
        .when(~extension.isin(extensions), "UNSUPPORTED_EXTENSION").when(F.col("content").isNull(), "FILE_READ_FAILED").when(F.contains(F.col("content"), F.lit(b"\0")), "BINARY_CONTENT")
    )
    return files.withColumn("error", error)


def precision_recall(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and recall of sets of rows by keys."""
    p, t = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)), truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    both = p.join(t, keys, "full").agg(F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull()).alias("hit"), F.count("_p").alias("predicted"), F.count("_t").alias("truth"))
    hit = F.col("hit").cast("double")
    return both.select("hit", "predicted", "truth", F.round(ratio(hit, F.col("predicted")), 6).alias("precision"), F.round(ratio(hit, F.col("truth")), 6).alias("recall"))


def count_delta(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """How far the number of predicted rows is from the true one, as a part of it."""
    both = predicted.agg(F.count("*").alias("predicted")).crossJoin(truth.agg(F.count("*").alias("truth")))  # a row each
    return both.withColumn("delta", F.round(ratio(F.abs(F.col("predicted") - F.col("truth")).cast("double"), F.col("truth")), 6))


def session_iou(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """For each true session (session_id, frame_id rows) its best intersection over union with a predicted one. Sizes are counted, pairs are those that share frames."""
    p = predicted.select(F.col("session_id").alias("p"), "frame_id").distinct()
    t = truth.select(F.col("session_id").alias("t"), "frame_id").distinct()
    shared = p.join(t, "frame_id").groupBy("p", "t").agg(F.count("*").alias("both"))
    sized = shared.join(p.groupBy("p").agg(F.count("*").alias("np")), "p").join(t.groupBy("t").agg(F.count("*").alias("nt")), "t")
    iou = F.col("both") / (F.col("np") + F.col("nt") - F.col("both"))
    best = sized.groupBy("t").agg(F.max(iou).alias("iou"))
    return t.select("t").distinct().join(best, "t", "left").select(F.col("t").alias("session_id"), F.round(F.coalesce("iou", F.lit(0.0)), 6).alias("iou"))


def p95_by_index(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value at place floor(0.95 n) - 1 of each key's sorted values, and 0 at least. Keys aren't null.

    Rows are counted by value before anything is ordered, so that a value that most rows have is one row; running counts of values go over slices.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    placed = sliced(counted, [F.col(key), F.col(value)], "p95")
    runs = placed.groupBy("_part", key).agg(F.sum("_c").alias("_in"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("_part", key, F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_past"))
    own = W.partitionBy("_part", key).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = rows.groupBy(key).agg(F.count(value).alias("_m"), F.count("*").alias("n"))
    ends = placed.join(runs, ["_part", key]).withColumn("_end", F.col("_past") + F.sum("_c").over(own)).join(n, key)
    at = F.greatest(F.floor(F.col("_m") * 0.95) - 1, F.lit(0))
    return ends.filter((F.col("_end") - F.col("_c") <= at) & (at < F.col("_end"))).select(key, F.col(value).alias(order), "n")
