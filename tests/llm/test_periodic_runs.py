"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import periodic_runs as pr


def brute(w):
    """(start, length, period) of all runs by comparing every word with every later one."""
    out, n = {}, len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(6, 4 * p):
                out.setdefault((start, i + p - start), p)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    drop = {i for s, m, p in runs for i in range(s + p, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_of_random_words_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 10])
            w = [b"%d" % rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n > 10:
                unit = w[: rng.randint(1, 8)]
                w = w[: rng.randint(0, 9)] + unit * rng.randint(3, 9) + unit[: rng.randint(0, len(unit))] + w[5:15]
            texts.append(w)
        for w, (runs, stay) in zip(texts, pr._examined(texts), strict=True):
            own = brute(w)
            assert [tuple(r) for r in runs.tolist()] == own
            drop = {i for s, m, p in own for i in range(s + p, s + m)}
            assert np.flatnonzero(~stay).tolist() == sorted(drop)


@pytest.mark.parametrize("unit, times", [(1, 200_000), (2, 100_000), (7, 30_000), (50_000, 5)])
def test_long_texts_of_one_run(unit, times):
    w = [b"%d" % i for i in range(unit)] * times
    ((runs, stay),) = pr._examined([w])
    assert runs.tolist() == [[0, unit * times, unit]] and stay.sum() == unit


def test_hostile_long_text_ends():
    w = [b"%d" % x for x in np.random.default_rng(0).integers(0, 2, 100_000)]
    ((runs, _),) = pr._examined([w])
    assert len(runs) > 1000


def test_query_equals_brute_force_on_a_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, "a a a a a a a"), (0, None), (1, ""), (2, " \t\n"), (3, "x"), (-50, "b " * 30), (2**63 - 1, "é é é é é é é é é é é é é"), (4, "w " * 5), (4, "w " * 5), (5, "w\x0bw\x0cw\rw\nw\tw")]
    rows += [(i, " ".join(rng.choice("abc" if i % 3 else "abcdefghijklmnop") for _ in range(rng.randint(0, 120)))) for i in range(10, 300)]
    spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = pr.op11_periodic_runs(spark, str(tmp_path))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(1 for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0 and t) > 10  # some were planted


def test_operator_returns_spans_and_texts_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([("k", "p q p q p q p q r")], "id string, body string")
    row = pr.periodic_runs(docs, "id", "body").first()
    assert (row["id"], row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == ("k", 9, [(0, 8, 2)], "p q r")
    assert pr.digest(pr.periodic_runs(docs.select(F.lit(1).alias("doc_id"), F.col("body").alias("text")).limit(0))).count() == 0
