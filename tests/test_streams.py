"""Streams whose state commits, is released, or goes on from history."""

import pytest
from pyspark.sql import functions as F

from chronolith.operators.linedelta import line_delta
from chronolith.streaming import commits as cm, release as rl, streams as st

FRAME = "frame_id long, context_key string, t string, extracted_text string"
IDLE = 300


def put(spark, path, rows):
    """Frames as files of a folder, one more with each call."""
    frame = spark.createDataFrame(rows, FRAME).withColumn("frame_timestamp", F.col("t").cast("timestamp")).drop("t").coalesce(1)
    frame.write.mode("append").parquet(path)


def frames(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def made(first, n):
    """Frames of three contexts, whose lines repeat, some of them without lines."""
    at = lambda i: f"2024-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00"
    return [(i, "abc"[i % 3], at(3 * i + (30 if i % 20 == 0 else 0)), "" if i % 11 == 5 else f"line {i % 4}\nline {i % 7}\nline {i % 4}\n\n own {i // 9}") for i in range(first, first + n)]


DELTA = ["frame_id", "epoch", "kept_lines", "delta_text"]


def held(df):
    return sorted(map(tuple, df.select(*DELTA).collect()))


def fails(condition):
    return lambda previews: previews.withColumn("failed", F.expr(condition))


def test_failed_frames_are_tried_again_and_the_result_is_the_batch_result(spark, tmp_path):
    put(spark, f"{tmp_path}/in", made(0, 60))
    put(spark, f"{tmp_path}/in", made(60, 60))
    run = cm.Transactions(f"{tmp_path}/tx", IDLE, fails("frame_id % 7 = 3 AND attempt < 3"))
    got = run.run(frames(spark, f"{tmp_path}/in"), patience=3)
    want = line_delta(spark.read.parquet(f"{tmp_path}/in"), idle=IDLE)
    assert held(got) == held(want)
    assert got.filter("frame_id % 7 = 3").agg(F.min("attempt")).first()[0] == 3 and run.counts(spark)[1] > 120


def test_what_fails_for_good_rolls_its_context_back(spark, tmp_path):
    """All from the frame on waits; frames that come later aren't accepted either, until it passes."""
    put(spark, f"{tmp_path}/in", made(0, 80))
    stuck = cm.Transactions(f"{tmp_path}/tx", IDLE, fails("frame_id = 40"))
    batch = lambda keep: held(line_delta(spark.read.parquet(f"{tmp_path}/in").filter(keep), idle=IDLE))
    assert held(stuck.run(frames(spark, f"{tmp_path}/in"))) == batch("frame_timestamp < '2024-01-01 02:30:00'")
    put(spark, f"{tmp_path}/in", made(80, 40))
    assert held(stuck.run(frames(spark, f"{tmp_path}/in"))) == batch("frame_timestamp < '2024-01-01 02:30:00'")
    mended = cm.Transactions(f"{tmp_path}/tx", IDLE, fails("false"))
    assert held(mended.run(frames(spark, f"{tmp_path}/in"))) == batch("true")


def test_a_crash_between_attempts_and_decisions_changes_nothing(spark, tmp_path):
    put(spark, f"{tmp_path}/in", made(0, 90))
    crashes = []

    def attempt(previews):
        crashes.append(1)
        if len(crashes) == 2:
            raise RuntimeError("lost")
        return fails("frame_id % 9 = 4 AND attempt < 2")(previews)

    run = cm.Transactions(f"{tmp_path}/tx", IDLE, attempt)
    with pytest.raises(Exception, match="lost"):
        run.run(frames(spark, f"{tmp_path}/in"))
    assert held(run.run(frames(spark, f"{tmp_path}/in"))) == held(line_delta(spark.read.parquet(f"{tmp_path}/in"), idle=IDLE))


def test_new_frames_wait_while_decisions_are_open(spark, tmp_path):
    """Two micro-batches in one run: the second sees no decision on the first, and previews nothing of its contexts."""
    put(spark, f"{tmp_path}/in", made(0, 30))
    put(spark, f"{tmp_path}/in", made(30, 30))
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = cm.Transactions(f"{tmp_path}/tx", IDLE, fails("frame_id % 5 = 1 AND attempt < 2"))
    assert held(run.run(source)) == held(line_delta(spark.read.parquet(f"{tmp_path}/in"), idle=IDLE))
    assert spark.read.parquet(f"{tmp_path}/tx/previews/batch=1").count() == 0


CONTROL = "frame_id long, k string, t string, blocked boolean"


def released(spark, tmp_path, frame_rows, control_rows, hold=3600):
    at = F.col("t").cast("timestamp")
    for name, rows, schema in (("f", frame_rows, "frame_id long, k string, t string"), ("c", control_rows, CONTROL)):
        spark.createDataFrame(rows, schema).withColumn("frame_timestamp", at).drop("t").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    read = lambda name: frames(spark, f"{tmp_path}/{name}")
    out = st.run_available(rl.stream_released(read("f"), read("c"), "k", hold, "1 day"), f"{tmp_path}/q")
    return sorted(tuple(r)[1:2] + (r["status"], r["place"]) for r in out.collect())


def test_held_frames_are_released_in_order_across_runs(spark, tmp_path):
    t = "2024-01-01 10:{:02d}:00".format
    first = released(spark, tmp_path, [(1, "k", t(1)), (5, "k", t(5)), (4, "k", t(4)), (9, "other", t(5))], [(3, "k", t(3), True)])
    assert first == [(1, "passed", 0), (9, "passed", 0)]
    second = released(spark, tmp_path, [(7, "k", t(7)), (9, "k", t(9))], [(8, "k", t(8), False)])
    assert second == [(1, "passed", 0), (4, "released", 1), (5, "released", 2), (7, "released", 3), (9, "passed", 0), (9, "passed", 4)]


def test_a_control_row_that_cannot_be_read_blocks(spark, tmp_path):
    t = "2024-01-01 10:{:02d}:00".format
    assert released(spark, tmp_path, [(1, "k", t(1)), (3, "k", t(3))], [(2, "k", t(2), None)]) == [(1, "passed", 0)]


def test_frames_held_too_long_are_given_up_by_timer(spark, tmp_path):
    assert released(spark, tmp_path, [(2, "k", "2024-01-01 10:02:00"), (9, "x", "2024-01-03 12:00:00")], [(1, "k", "2024-01-01 10:01:00", True)]) == [(2, "dropped", None), (9, "passed", 0)]


def test_the_session_keeps_its_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "some.Other")
    try:
        with st.rocksdb(spark):
            assert spark.conf.get(key) == st.ROCKSDB
        assert spark.conf.get(key) == "some.Other"
    finally:
        spark.conf.set(key, before)
