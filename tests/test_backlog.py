"""Pages of history, bounded calls, summaries, ranges of any number and width."""

import shutil
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronolith.operators import ingest as ig, intervals as iv, linedelta as ld, pool as po, summaries as su
from chronolith.sources import backlog as bl
from chronolith.streaming import streams as st


def history(spark, n):
    return spark.range(n).select(F.col("id").alias("frame_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 50).alias("frame_timestamp"), F.lit("x").alias("page"))


def test_pages_hold_the_window_in_order_and_a_replay_takes_each_row_once(spark, tmp_path):
    rows = history(spark, 1000).drop("page")
    b = bl.paged(rows, f"{tmp_path}/pages", 300, "2023-11-14 22:13:20", "2023-11-14 22:13:59")
    stored = spark.read.parquet(b.path)
    assert b.rows == stored.count() == rows.filter("frame_timestamp <= '2023-11-14 22:13:59'").count() == 800
    bounds = stored.groupBy("page").agg(F.count("*").alias("n"), F.min(F.struct("frame_timestamp", "frame_id")).alias("lo"), F.max(F.struct("frame_timestamp", "frame_id")).alias("hi")).orderBy("page").collect()
    assert [r["n"] for r in bounds] == [300, 300, 200] and all(a["hi"] < z["lo"] for a, z in zip(bounds, bounds[1:], strict=False))
    assert bl.replayed(spark, b, 2, lambda s: st.started(s, f"{tmp_path}/q")) == 2
    got = [r["frame_id"] for r in spark.read.parquet(f"{tmp_path}/q/out").collect()]
    assert len(got) == len(set(got)) == 800
    assert bl.replayed(spark, b, 2, lambda s: st.started(s, f"{tmp_path}/q")) == 1  # nothing is left
    assert spark.read.parquet(f"{tmp_path}/q/out").count() == 800


def test_a_stuck_page_raises_and_a_mended_one_goes_on(spark, tmp_path):
    b = bl.paged(history(spark, 500).drop("page"), f"{tmp_path}/pages", 200)
    shutil.move(f"{b.path}/page=1", f"{tmp_path}/aside")
    with pytest.raises(Exception, match="no progress beyond backlog offset 200"):
        bl.replayed(spark, b, 1, lambda s: st.started(s, f"{tmp_path}/q"))
    assert spark.read.parquet(f"{tmp_path}/q/out").count() == 200
    shutil.move(f"{tmp_path}/aside", f"{b.path}/page=1")
    bl.replayed(spark, b, 1, lambda s: st.started(s, f"{tmp_path}/q"))
    assert spark.read.parquet(f"{tmp_path}/q/out").select("frame_id").distinct().count() == 500


def talk(spark, n):
    """Frames whose lines come again, in three contexts; one is silent for long, in its frames and others' too."""
    texts = [None if i % 11 == 0 else "\n".join(f" line {(i * k) % 23} " if k % 4 else "" for k in range(i % 7)) + ("\nline 1\nline 1" if i % 5 == 0 else "") for i in range(n)]
    return spark.createDataFrame([(i, "abc"[i % 3] if i % 50 < 40 else "a", datetime(2024, 1, 1) + timedelta(seconds=60 * i + 4000 * (i // 60)), t) for i, t in enumerate(texts)], "frame_id long, c string, frame_timestamp timestamp, extracted_text string")


def replay_of_few(spark, path, n, every=32, fails=()):
    fails, state = set(fails), st.LineState(f"{path}/state", 900, every)
    b = bl.paged(talk(spark, n), f"{path}/pages", 10, columns=ld.line_columns("c"))

    def take(frames, number, lines):
        if number == 0:
            st.begun(spark, state, None)
        state.take_few(number, frames, lines, f"{path}/out/batch={number}")
        if number in fails:
            fails.remove(number)
            raise ValueError("after all was written")

    def go():
        return bl.replayed_in_one(spark, b, 2, f"{path}/checkpoint", take, "size(own)")

    while fails:
        with pytest.raises(Exception, match="after all was written"):
            go()
    return go()


def test_a_replay_in_one_query_is_line_delta(spark, tmp_path):
    """With steps that keep the lines of open epochs only, a run that fails once all is written, and after the end."""
    want = {(r["frame_id"], r["c"], r["epoch"], r["kept_lines"], r["delta_text"]) for r in ld.line_delta(talk(spark, 190), "c", 900).collect()}
    assert replay_of_few(spark, str(tmp_path), 190, 3, (2, 4)) == 6
    got = list(map(tuple, spark.read.schema(st.DELTA).parquet(f"{tmp_path}/out").drop("batch").collect()))
    assert len(got) == 190 and set(got) == want and len({e for _, _, e, _, _ in want}) > 2 and any(k for _, _, _, k, _ in want)


def test_a_run_takes_few_jobs_and_as_many_tasks_whatever_the_session_shuffles_into(spark, tmp_path):
    """A run of few rows is one micro-batch of a query that goes on, with a few jobs of a few tasks."""
    scheduler, before = spark.sparkContext._jsc.sc().dagScheduler(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        used = []
        for n in (40, 120):
            at = int(scheduler.nextJobId()), int(scheduler.nextStageId())
            replay_of_few(spark, f"{tmp_path}/{n}", n)
            used.append((int(scheduler.nextJobId()) - at[0], int(scheduler.nextStageId()) - at[1]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert used[1][0] - used[0][0] <= 4 * 11 and not list(tmp_path.glob("*/out/*/part-00001*"))


def test_a_page_with_other_rows_or_none_ends_a_replay_in_one_query(spark, tmp_path):
    b = bl.paged(history(spark, 50).drop("page"), f"{tmp_path}/pages", 20)
    took = []
    take = lambda rows, number, n: (took.append((number, n)), rows.write.mode("overwrite").parquet(f"{tmp_path}/out/{number}"))
    go = lambda: bl.replayed_in_one(spark, b, 1, f"{tmp_path}/checkpoint", take)
    shutil.move(f"{b.path}/page=1", f"{tmp_path}/aside")
    with pytest.raises(Exception, match="no progress beyond backlog offset 20"):
        go()
    shutil.copytree(f"{b.path}/page=2", f"{b.path}/page=1")
    with pytest.raises(Exception, match="no progress beyond backlog offset 20"):
        go()
    assert took == [(0, 20)]
    shutil.rmtree(f"{b.path}/page=1")
    shutil.move(f"{tmp_path}/aside", f"{b.path}/page=1")
    assert go() == 2 and took == [(0, 20), (1, 20), (2, 10)] and go() == 0
    assert spark.read.parquet(*[f"{tmp_path}/out/{n}" for n in range(3)]).select("frame_id").distinct().count() == 50


def test_an_empty_window_has_no_pages(spark, tmp_path):
    reader = bl.BacklogReader({"from": "a", "to": "b", "rows": "0", "size": "10", "pages": "3"})
    pages, end = reader.read(reader.initialOffset())
    assert list(pages) == [] and end == reader.initialOffset()
    reader = bl.BacklogReader({"from": "a", "to": "b", "rows": "25", "size": "10", "pages": "2"})
    pages, end = reader.read(reader.initialOffset())
    assert list(pages) == [(0, 10), (1, 10)] and end["offset"] == 20
    pages, last = reader.read(end)
    assert list(pages) == [(2, 5)] and last["offset"] == 25 and list(reader.read(last)[0]) == [] and list(reader.readBetweenOffsets(end, last)) == [(2, 5)]


def test_windows_of_fetch_and_backlog():
    now = datetime(2024, 1, 1, 12)
    back = lambda minutes: now - timedelta(minutes=minutes)
    assert ig.fetch_window(None) == (45, True) and ig.fetch_window(3.2) == (15, False) and ig.fetch_window(20.1) == (21, False) and ig.fetch_window(45.0) == (45, False) and ig.fetch_window(45.5) == (45, True)
    assert bl.window_of(None, now) == (back(45), now)
    assert bl.window_of(back(10), now) is None and bl.window_of(now + timedelta(minutes=1), now) is None
    assert bl.window_of(back(600), now) == (back(45), now)


def test_calls_are_bounded_overlap_and_keep_their_order(spark):
    rows = spark.range(40).withColumn("started", F.lit(None).cast("double"))

    def call(row):
        began = time.time()
        time.sleep(0.05 if row["id"] % 4 else 0.15)
        if row["id"] % 10 == 3:
            raise ValueError(f"no {row['id']}")
        return [began, time.time()]

    got = po.called(rows.coalesce(1), call, "array<double>", bound=3, tasks=1).collect()
    assert [r["id"] for r in got] == sorted(r["id"] for r in got) and len(got) == 40
    assert {r["error"] for r in got if r["error"]} == {f"ValueError: no {i}" for i in (3, 13, 23, 33)} and all((r["value"] is None) == (r["error"] is not None) for r in got)
    spans = [r["value"] for r in got if r["value"]]
    peak = max(sum(a <= start < b for a, b in spans) for start, _ in spans)
    assert 2 <= peak <= 3
    wall = max(b for _, b in spans) - min(a for a, _ in spans)
    assert wall < 0.85 * sum(b - a for a, b in spans)


def test_the_bound_holds_over_tasks(spark):
    got = po.called(spark.range(24), lambda row: (time.sleep(0.1), [time.time() - 0.1, time.time()])[1], "array<double>", bound=4, tasks=9).collect()
    spans = [r["value"] for r in got]
    assert max(sum(a <= start < b for a, b in spans) for start, _ in spans) <= 4


def test_no_text_at_all(spark):
    frames = spark.createDataFrame([(1, "2024-01-01", None, "h"), (2, "2024-01-02", "", "h")], "frame_id long, frame_timestamp string, extracted_text string, text_hash string")
    cache = spark.createDataFrame([], "hash string, embedding array<double>")
    got = po.embedding_outcomes(frames, cache, len).select("frame_id", "outcome", "embedding", "error").collect()
    assert sorted(map(tuple, got)) == [(1, "skipped-empty", None, None), (2, "skipped-empty", None, None)]


SESSIONS = "session_id string, app_name string, context_label string, started_at timestamp, ended_at timestamp, active_seconds double, frames long, summary_text string, summary_status string, summary_provider_kind string, summary_generated_at timestamp, other int"


def test_a_provider_is_asked_only_where_it_may_be(spark):
    t0 = datetime(2024, 1, 1)
    base = ("app", "c", t0, t0, 60.0, 2)
    sessions = spark.createDataFrame([("ready", *base, "kept", "ready", "llm", t0, 1), ("new", *base, None, "pending", None, None, 2), ("blank", "app", None, t0, t0, 60.0, 2, "old", "pending", None, None, 3)], SESSIONS)
    wanted = sessions.select("session_id").unionByName(spark.createDataFrame([("gone",), ("new",)], "session_id string"))

    def provider(row):
        raise RuntimeError(f"asked for {row['session_id']}")

    now = F.lit(datetime(2024, 2, 1))
    status = lambda df: {r["session_id"]: (r["summary_status"], r["summary_provider_kind"], r["stored"]) for r in df.collect()}
    paused = status(su.ensured(wanted, sessions, provider, "llm", F.lit(True), now))
    unknown = status(su.ensured(wanted, sessions, provider, "llm", F.lit(None).cast("boolean"), now))
    assert paused == unknown == status(su.ensured(wanted, sessions, None, "llm", F.lit(False), now))
    assert paused == {"ready": ("ready", "llm", False), "new": ("ready", "template", True), "blank": ("failed", "template", True), "gone": ("failed", "template", False)}
    free = su.ensured(wanted, sessions, provider, "llm", F.lit(False), now)
    assert status(free) == paused | {"new": ("degraded", "template", True)}
    after = {r["session_id"]: r for r in su.stored(sessions, free).collect()}
    assert after["blank"]["summary_status"] == "failed" and after["blank"]["summary_text"] == "old" and after["new"]["summary_generated_at"] == datetime(2024, 2, 1) and after["ready"]["summary_text"] == "kept"
    fragments = spark.createDataFrame([("new", ["a", "b"])], "session_id string, fragments array<string>")
    told = su.ensured(wanted, sessions, lambda row: "|".join(row["fragments"]), "llm", F.lit(False), now, evidence=fragments)
    assert {r["session_id"]: r["summary_text"] for r in told.collect()}["new"] == "a|b"


def test_a_million_ranges_and_an_open_one(spark):
    """No day is exploded and no range meets each row: what the plan makes stays in proportion to its input."""
    at = lambda c: F.timestamp_seconds(c)
    ranges = spark.range(1_000_000).select(at(F.col("id") * 100).alias("from"), at(F.col("id") * 100 + 9).alias("to"))
    ranges = ranges.unionByName(spark.createDataFrame([(datetime(2001, 9, 9), datetime(9999, 1, 1))], "`from` timestamp, `to` timestamp"))
    rows = spark.range(20_000).select("id", at(F.col("id") * 50_021).alias("ts"))
    got = {r["id"] for r in iv.outside(rows, ranges, "ts").collect()}
    bound = datetime(2001, 9, 9).timestamp()
    want = {i for i in range(20_000) if not (i * 50_021 % 100 <= 9 and i * 50_021 < 10**8 or i * 50_021 >= bound)}
    assert got == want


def test_ranges_of_odd_kinds(spark):
    days = lambda *xs: [tuple(None if x is None else datetime(2024, 1, x) for x in row) for row in xs]
    ranges = spark.createDataFrame(days((3, 5), (3, 5), (4, 6), (6, 7), (20, 10), (None, 9), (9, None), (12, 12)), "`from` timestamp, `to` timestamp")
    assert sorted(map(tuple, iv.merged(ranges).collect())) == days((3, 7), (12, 12))
    rows = spark.createDataFrame([(i, datetime(2024, 1, i), "clash") for i in range(1, 15)] + [(99, None, "clash")], "id int, ts timestamp, _to string")
    for most in (0, 100):
        kept = iv.outside(rows, ranges, "ts", most=most)
        assert kept.columns == rows.columns and sorted(r["id"] for r in kept.collect()) == [1, 2, 8, 9, 10, 11, 13, 14, 99]
        assert iv.outside(rows, ranges.limit(0), "ts", most=most).count() == 15 and iv.outside(rows.limit(0), ranges, "ts", most=most).count() == 0
