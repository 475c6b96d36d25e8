from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from chronolith.operators import diagnostics as dg, ingest as ig, lifecycle as lc, routines as rt, search as se, sessions as ss
from chronolith.operators.find import find
from chronolith.operators.linedelta import epochs, line_delta
from chronolith.session import ranked

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frames(spark, rows):
    return spark.createDataFrame([(i, at(t), a, x) for i, t, a, x in rows], "frame_id long, frame_timestamp timestamp, app_name string, extracted_text string")


def test_gap_of_exactly_idle_extends_a_session(spark):
    n = ss.sessionized(frames(spark, [(1, 0, "a", ""), (2, 120, "a", ""), (3, 241, "a", ""), (4, 0, None, "")]), ["app_name"])
    got = {r.frame_id: r.session_id for r in n.collect()}
    assert got[1] == got[2] != got[3] and got[4] not in (got[1], got[3])
    s = {r.session_id: r for r in ss.sessions_of(n, ["app_name"]).collect()}
    assert s[got[1]].active_seconds == 120 and s[got[1]].evidence_frame_ids == [1, 2] and s[got[3]].active_seconds == 0


def test_flush_is_strict_and_idempotent(spark):
    s = ss.sessions_of(ss.sessionized(frames(spark, [(1, 0, "a", "")]), ["app_name"]), ["app_name"])
    now = lambda x: F.lit(at(x)).cast("timestamp")
    assert ss.idle_flushed(s, now(120)).first()["is_open"] and not ss.idle_flushed(s, now(121)).first()["is_open"]


def test_recall_splits_sessions_across_hours(spark):
    n = ss.sessionized(frames(spark, [(1, 3590, "a", ""), (2, 3610, "a", "")]), ["app_name"])
    got = [(r.sessions, r.seconds) for r in ss.recall_totals(n, "hour").orderBy("bucket_start").collect()]
    assert got == [(1, 20), (1, 1)]


def test_empty_texts_never_match_and_bounds_are_inclusive(spark):
    f = frames(spark, [(1, 0, "a", ""), (2, 10, "a", "Hello"), (3, 20, "a", "hello")])
    assert {r.frame_id for r in se.matching(f, "HELLO", at(10), at(20)).collect()} == {2, 3}
    assert se.matching(f, "").count() == 2


def test_same_time_pages_break_ties_by_id(spark):
    f = frames(spark, [(i, 0, "a", "x") for i in range(5)])
    page = se.newest(f, 2)
    assert [r.frame_id for r in page.collect()] == [4, 3]
    assert [r.frame_id for r in se.newest(f, 2, (at(0), 3)).collect()] == [2, 1]


def test_unowned_hits_leave_groups(spark):
    hits = spark.createDataFrame([(0, 7, "s1"), (1, 8, None), (2, 9, "s1")], "rank long, frame_id long, session_id string")
    got = se.grouped_by_session(hits).collect()
    assert [(r.session_id, r.frame_ids) for r in got] == [("s1", [7, 9])]


def test_line_delta(spark):
    f = frames(spark, [(1, 0, "a", "x\ny\nx"), (2, 10, "a", "x\ny"), (3, 20, "a", "z\nx"), (4, 30, "b", "x"), (5, 400, "a", "x"), (6, 410, "a", "")])
    got = {r.frame_id: (r.delta_text, r.delta_hash) for r in line_delta(f, "app_name", 300).collect()}
    assert got[1][0] == "x\ny\nx" and got[2] == ("", None) and got[3][0] == "z" and got[4][0] == "x" and got[5][0] == "x" and got[6][0] == ""


def test_checkpoint_never_passes_a_failed_frame(spark):
    r = spark.createDataFrame([(at(1), 1, False), (at(2), 2, True), (at(3), 3, False)], "frame_timestamp timestamp, frame_id long, failed boolean")
    got = ig.checkpoint(r).first()
    assert (got["checkpoint_id"], got["ceiling_id"]) == (1, 2)
    assert ig.checkpoint(r.filter("frame_id = 2")).first()["checkpoint_id"] is None


def test_embedding_runs_once_a_text(spark):
    f = spark.createDataFrame([(1, "h1", "a"), (2, "h1", "a"), (3, "h2", "b")], "frame_id long, text_hash string, extracted_text string")
    cache = spark.createDataFrame([("h2", [0.5])], "hash string, embedding array<double>")
    out, new = ig.embedded(f, cache, lambda t: F.array(F.length(t).cast("double")))
    assert new.count() == 1 and {r.frame_id: r.embedding for r in out.collect()} == {1: [1.0], 2: [1.0], 3: [0.5]}


def test_any_evidence_frame_deletes_the_session(spark):
    s = spark.createDataFrame([("s1", [1, 2]), ("s2", [3])], "session_id string, evidence_frame_ids array<long>")
    assert [r.session_id for r in lc.sessions_without_frames(s, spark.createDataFrame([(2,)], "frame_id long")).collect()] == ["s2"]


def test_retention_takes_oldest_batches_with_tied_times(spark):
    f = spark.createDataFrame([(i, at(0), 10) for i in range(10)], "frame_id long, frame_timestamp timestamp, bytes long")
    cut = lc.retention_cut(f, 45, at(100), batch=2)
    assert sorted(r.frame_id for r in cut.collect()) == [0, 1, 2, 3, 4, 5]
    assert lc.retention_cut(f, 45, at(0), batch=2).count() == 0


def test_secure_subtree_is_pruned_at_any_depth(spark):
    n = spark.createDataFrame([(1, 1, None, "w"), (1, 2, 1, "Secure"), (1, 3, 2, "x"), (1, 4, 3, "y"), (2, 3, 2, "x")], "frame_id long, id long, parent_id long, role string")
    assert sorted((r.frame_id, r.id) for r in lc.secure_subtrees(n, ["SECURE"]).collect()) == [(1, 1), (2, 3)]


def test_definitions_keep_their_creation_time(spark):
    d = spark.createDataFrame([("a", at(0), "old")], "name string, created_at timestamp, prompt string")
    got = rt.defined(d, spark.createDataFrame([("a", at(9), "new")], d.schema)).first()
    assert (got["created_at"], got["prompt"]) == (at(0), "new")


def test_memory_append_and_replace(spark):
    m = spark.createDataFrame([("memory", "a"), ("user", "")], "scope string, content string")
    got = {r.scope: r.content for r in rt.memory_written(m, "memory", "b").collect()}
    assert got == {"memory": "a\n\nb", "user": ""}
    assert {r.scope: r.content for r in rt.memory_written(m, "user", "c").collect()}["user"] == "c"


def test_precision_and_coverage(spark):
    a, b = (spark.createDataFrame([(i,) for i in x], "k int") for x in ((1, 2, 3), (2, 3, 4, 5)))
    got = rt.precision_recall(a, b, ["k"]).first()
    assert (got["precision"], got["recall"]) == (round(2 / 3, 6), 0.5)
    assert [dg.coverage(["a", "b"], x) for x in (["a", "b"], ["a", "z"], ["z"])] == ["full", "partial", "unsupported"]


def test_ranked_is_gapless_with_a_hot_key(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), "id")
    got = ranked(df, "key", [F.col("id")], "test").collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append((r.id, r["rank"]))
    assert all([k for _, k in sorted(v)] == list(range(len(v))) for v in by.values()) and len(got) == 1000


def test_keyword_search_pushes_bounds_to_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    frames(spark, [(1, 0, "a", "x")]).write.parquet(str(tmp_path / "f"))
    plan = se.newest(se.matching(spark.read.parquet(str(tmp_path / "f")), "x", at(0), at(9), "a", normalised=True), 5)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(frame_timestamp" in plan and "EqualTo(app_name,a)" in plan and "TakeOrderedAndProject" in plan


def test_secure_cycles_end_and_frames_without_a_tree_lose_secure_rows_only(spark):
    n = spark.createDataFrame(
        [(1, "a", "b", None, "secure"), (1, "b", "a", None, "x"), (1, "c", None, None, "x"), (2, "a", None, None, "secure"), (2, "a", None, None, "x"), (None, "z", None, None, "Secure"), (None, "z", None, None, "y"),
         (3, "p", None, "0.1", "secure"), (3, "q", None, "0.1.4.2", "x"), (3, "r", None, "0.10", "x"), (3, "s", None, None, "x")],
        "frame_id long, id string, parent_id string, path string, role string",
    )
    got = sorted(((r.frame_id or 0, r.id, r.role) for r in lc.secure_subtrees(n, ["SECURE"]).collect()))
    assert got == [(0, "z", "y"), (1, "c", "x"), (2, "a", "x"), (3, "r", "x"), (3, "s", "x")]


def test_epochs_over_slices_equal_a_loop(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice("ab"), at(r.randrange(4000))) for i in range(400)]
    got = {x.frame_id: (x.epoch, x.seq) for x in epochs(spark.createDataFrame(rows, "frame_id long, c string, frame_timestamp timestamp"), "c", 30).collect()}
    for c in "ab":
        epoch, last = 0, None
        for seq, (i, _, ts) in enumerate(sorted((x for x in rows if x[1] == c), key=lambda x: (x[2], x[0])), 1):
            epoch += last is None or (ts - last).total_seconds() > 30
            last = ts
            assert got[i] == (epoch, seq)


def test_find_says_what_it_could_not_do(spark):
    f = frames(spark, [(i, i * 10, "a", "needle" if i % 3 == 0 else "hay") for i in range(30)]).withColumn("user_id", F.lit(1))
    whole = find(f, f, ["user_id"], "NEEDLE", idle=60)
    assert whole.degraded is None and [r.frame_id for r in whole.hits.orderBy("rank").collect()] == list(range(27, -1, -3))
    assert whole.groups.count() == 1 and "10" in whole.narrative.first()["narrative"]
    short = find(f, f, ["user_id"], "needle", idle=60, budget=7)
    assert "truncated at 7 rows" in short.degraded["reason"] and sorted(r.frame_id for r in short.hits.collect()) == [24, 27]
    assert find(f, f, ["user_id"], "needle", idle=60, budget=7, limit=2).degraded is None
    assert find(f, f, ["user_id"], "needle", idle=60, mode="semantic").degraded["actual_mode"] == "keyword"
    assert find(f, f, ["user_id"], "needle", idle=60, mode="hybrid").degraded is None
    assert find(f, f, ["user_id"], "nothing", idle=60).narrative.first()["hits"] == 0


def test_plans_send_around_what_is_small(spark, tmp_path):
    frames(spark, [(i, i * 10, "a", "x") for i in range(9)]).withColumn("user_id", F.lit(1)).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = find(f, f, ["user_id"], "x", idle=60, normalised=True)
    plan = found.hits._jdf.queryExecution().toString()
    assert "EqualTo(user_id,1)" in plan or "In(user_id" in plan
    assert "SortMergeJoin" not in plan


def test_intermediate_tables_can_be_cleared(spark):
    from chronolith.session import clear_intermediate, materialize

    df = materialize(spark.range(5).toDF("id"), "test")
    assert df.count() == 5 and clear_intermediate(spark) and not clear_intermediate(spark)


def test_log_tail_and_folders(spark, tmp_path):
    from chronolith.sources import readers as rd

    (tmp_path / "a.log").write_text("\n".join(["plain", *(f'{{"level": "Warn", "message": "m{i}"}}' for i in range(50))]))
    got = rd.log_tail(spark, str(tmp_path / "a.log"), 3, "WARN").collect()
    assert [r.message for r in got] == ["m49", "m48", "m47"]
    assert rd.folder_bytes(spark, str(tmp_path)).first()["files"] == 1
    assert rd.folder_bytes(spark, str(tmp_path / "none")).first()["exists"] is False


def test_vector_and_checkpoint_files(spark, tmp_path):
    import pytest

    from chronolith.sources import readers as rd

    path = tmp_path / "v.json"
    assert rd.vectors_file(spark, str(path)).count() == 0 and rd.checkpoint_file(spark, str(path)).count() == 0
    path.write_text('{"records": [{"id": "extracted:1", "text": "t", "timestamp": "2024-01-01T00:00:00Z", "embedding": [1, 0.5], "metadata": {"sourceTypes": ["ocr"]}}]}')
    got = rd.vectors_file(spark, str(path)).first()
    assert got["embedding"] == [1.0, 0.5] and got["metadata"]["sourceTypes"] == ["ocr"]
    path.write_text('{"records": [{"id": "x", "text": "t"}]}')
    with pytest.raises(Exception, match="without id"):
        rd.vectors_file(spark, str(path)).collect()
    (tmp_path / "c.json").write_text('{\n "timestamp": "2024-01-01T00:00:00Z",\n "cursor": "a"\n}')
    assert rd.checkpoint_file(spark, str(tmp_path / "c.json")).first()["cursor"] == "a"


def test_sessions_across_days_keys_without_a_name_and_times_that_are_missing(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1, 22)
    rows = [(i, rng.choice(["a", None, "b"]), start + dt.timedelta(seconds=rng.randrange(5 * 86_400)) if rng.random() < 0.95 else None) for i in range(400)]
    got = {r["frame_id"]: (r["session_no"], r["gap_seconds"]) for r in ss.sessionized(spark.createDataFrame(rows, "frame_id int, k string, frame_timestamp timestamp"), ["k"], 3600).collect()}
    want = {}
    for key in ("a", None, "b"):
        last, n = None, -1
        for i, _, t in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or start, r[0])):
            gap = (t - last).total_seconds() if t and last else None
            n, gap = (n, gap) if gap is not None and gap <= 3600 else (n + 1, None)
            want[i], last = (n, gap), t
    assert got == want


def test_status_is_told_where_vectors_cannot_be_read(spark):
    frames_ = frames(spark, [(1, 0, "a", "x"), (2, 60, "a", "")]).withColumn("bytes", F.lit(10))
    sessions = spark.createDataFrame([(True, "ready"), (False, "failed")], "is_open boolean, summary_status string")
    facts = spark.createDataFrame([(at(90), True, 5, False, "2024-01-01", False)], "now timestamp, running boolean, process_age int, persisted boolean, checkpoint string, backlog boolean")
    got = dg.internal_status(frames_, sessions, None, facts, 100).first()
    assert (got["capture"], got["recovery"], got["accessibility"], got["headroom"], got["empty"], got["open"], got["failed"]) == ("ok", "degraded", None, 80, 1, 1, 1)
    vectors = spark.createDataFrame([], "source_types array<string>")
    assert dg.internal_status(frames_, sessions, vectors, facts, 100).first()["recovery"] == "ready"
    assert dg.internal_status(frames_, sessions, vectors, facts.withColumn("checkpoint", F.lit(None).cast("string")), 20).select("recovery", "disk_warning", "checkpoint_exists").first() == ("needs-rebuild", True, False)
    assert dg.internal_status(frames_.limit(0), sessions.limit(0), vectors, facts, 20).select("capture", "total").first() == ("unknown", 0)
