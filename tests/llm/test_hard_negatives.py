"""Hard negatives against brute force and SQL."""

import duckdb
import numpy as np
import pytest

from chronolith.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=3):
    rows = sorted({(i, label, tuple(x)) for i, label, x in rows if None not in (i, label, x)})
    out = []
    for a, own, x in rows:
        if a % 50:
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y, strict=False))
        others = sorted((-score(y), i, label) for i, label, y in rows if i != a)
        for minus, p, _ in [r for r in others if r[2] == own][:positives]:
            hard = [(i, -m) for m, i, label in others if label != own and 50 * -minus <= 100 * -m <= 95 * -minus][:negatives]
            out += [(a, p, rank, n, -minus, s) for rank, (n, s) in enumerate(hard, 1)]
    return sorted(out)


def made(seed, n=900, length=8, spread=12, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, (5, length))
    x = centres[rng.integers(0, 5, n)] + rng.integers(-spread, spread + 1, (n, length))
    ids = rng.permutation(n) * 5 - 100
    return [(int(i), int(label), [int(v) for v in row]) for i, label, row in zip(ids, rng.integers(0, labels, n), x, strict=True)]


@pytest.mark.parametrize("seed, spread, leaf", [(0, 12, 8), (1, 1, 8), (2, 60, 256)])
def test_equals_brute_force(spark, monkeypatch, seed, spread, leaf):
    """Spread 1 makes many copies and ties; leaves of 8 rows make deep trees and many parts."""
    monkeypatch.setattr(hn, "LEAF", leaf)
    rows = made(seed, spread=spread, labels=2 if seed else 3)
    rows += rows[:30] + [(100000, 0, [0] * 8), (100050, 1, [0] * 8), (None, 0, [1] * 8), (100100, None, [1] * 8), (100150, 0, None), (100200, 7, [5] * 8), (2**63 - 8, 1, [3, 4]), (100250, 1, [])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, label int, x array<bigint>, entry string")
    got = sorted(map(tuple, hn.hard_negatives(df, df["id"] % 50 == 0).collect()))
    assert got == brute(rows) and len(got) > 100


def test_the_tree_leaves_rows_out_on_clustered_vectors(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 16)
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (40, 16))
    x = (centres[rng.integers(0, 40, 20_000)] + rng.integers(-9, 10, (20_000, 16))).astype(float)
    label = rng.integers(0, 5, len(x))
    tree = hn.VantageTree(x, label, np.arange(len(x)), float(np.sqrt((x * x).sum(axis=1).max())))
    scored = 0
    for a in x[:50]:
        own = a @ a
        found, seen = tree.nearest(a, 0, False, np.array([[0.9 * own, 0.95 * own]]), 3)
        scores = x @ a
        fit = np.flatnonzero((label != 0) & (scores >= 0.9 * own) & (scores <= 0.95 * own))
        want = sorted(zip((-scores[fit]).astype(int).tolist(), fit.tolist(), strict=True))[:3]
        assert [(m, i) for m, i, _ in found[0]] == want
        scored += seen
    assert scored < 0.5 * 50 * len(x)


def test_query_equals_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.standard_normal(6) / 3], int(rng.integers(0, 10))) for i in range(600)]
    rows += [(600 + i, rows[0][1], 3) for i in range(60)] + [(1000, [float("nan")] * 6, 1), (1050, [None] * 6, 1), (1100, None, 1), (1150, rows[1][1], None), (1200, [float("inf")] * 6, 2), (None, rows[2][1], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(tuple(r) for r in hn.op13_vantage_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == sorted(con.execute(hn.SQL).fetchall()) and got


def test_scores_beyond_53_bits_are_refused_and_empty_tables_are_empty(spark):
    schema = "id long, label int, x array<bigint>"
    big = spark.createDataFrame([(0, 1, [1 << 30]), (1, 1, [1 << 30])], schema)
    with pytest.raises(ValueError, match="53 bits"):
        hn.hard_negatives(big, big["id"] == 0)
    empty = spark.createDataFrame([], schema)
    assert hn.hard_negatives(empty, empty["id"] == 0).count() == 0
