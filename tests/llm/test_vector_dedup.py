"""Near-duplicate vectors against brute force."""

import numpy as np
import pytest

from chronolith.llm import vector_dedup as vd

SCHEMA = "id long, embedding array<double>, label string, buckets string, n long"


def brute(rows, threshold=0.98):
    """(id, links, component) of each row by all cosines."""
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for i, (own, _, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return sorted(((own, links[i], least.get(root(i))) for i, (own, _, _) in enumerate(rows)), key=str)


def table(seed=0, n=150, length=16, copies=60):
    """Random vectors, a group of near copies around one of them, some of these repeated, and rows of every odd kind."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, length))
    vectors = [list(map(float, v)) for v in base]
    for spread, i in ((0.02, 0), (0.06, 1), (0.17, 2)):
        noise = rng.standard_normal((copies, length))
        noise /= np.linalg.norm(noise, axis=1)[:, None]
        vectors += [list(map(float, v)) for v in base[i] / np.linalg.norm(base[i]) + spread * noise]
    vectors += vectors[n : n + 20] + [[2 * x for x in v] for v in vectors[n : n + 5]]
    rows = [(int(i), v, str(i % 2)) for i, v in zip(rng.permutation(len(vectors)) * 3 - 7, vectors, strict=True)]
    v = vectors[0]
    odd = [(5000, None, "0"), (5001, [], "0"), (5002, [0.0] * length, "0"), (5003, [None, *v[1:]], "0"), (5004, [float("nan"), *v[1:]], "0"), (5005, [float("inf"), *v[1:]], "0"), (5006, v, None)]
    odd += [(None, v, "9"), (5007, v, "9"), (None, v[:5], "9"), (5007, v, "9"), (5008, [1e300] * length, "8"), (5009, [1e-300] * length, "8"), (2**63 - 1, [-0.0, 1.0], "7"), (5010, [0.0, 1.0], "7")]
    return rows + odd


@pytest.mark.parametrize("block", [vd.BLOCK, 7])
def test_links_and_components_equal_brute_force(spark, block):
    """With blocks of 7 classes the groups go through balls and many blocks."""
    rows = table()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = vd.near_duplicates(df, block=block, miss=1e-6).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_recall_of_pairs_just_at_the_threshold(spark):
    """Pairs at a cosine of 0.98 to 0.981 each: with MISS at 0.001 nearly all of 2,000 are found, and none below the threshold."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.979, 0.981, len(a))
    b = cosine[:, None] * a + np.sqrt(1 - cosine**2)[:, None] * side
    cosine = (a * b).sum(axis=1) / np.linalg.norm(b, axis=1)
    rows = [(2 * i + j, list(map(float, v)), "x") for i in range(len(a)) for j, v in enumerate((a[i], b[i]))]
    got = {r["id"]: r for r in vd.near_duplicates(spark.createDataFrame(rows, "id long, embedding array<double>, label string")).collect()}
    linked = np.array([got[2 * i + 1]["component_id"] == 2 * i for i in range(len(a))])
    assert not linked[cosine < 0.98 - 1e-12].any()
    assert linked[cosine >= 0.98].mean() > 0.995


def test_tables_of_the_query(spark, tmp_path):
    assert vd.op12_pstable_dedup(spark, "/root/testdata/sf0.001").filter("n_links > 0 OR NOT kept").count() == 0  # no pair of that table is near
    rows = [(i, v, None if label is None else int(label)) for i, v, label in table(3, copies=30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()]
    got = vd.op12_pstable_dedup(spark, str(tmp_path)).collect()
    wanted = brute([(i, v, label) for i, v, label in stored])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == wanted
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_empty_table(spark):
    assert vd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
