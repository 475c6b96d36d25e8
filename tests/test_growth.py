"""What must not grow with the largest context, the number of held frames, the length of a history, or the texts of an Arrow batch."""

from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.functions import arrow as ar, text as tx, trees as tr
from chronolith.operators.linedelta import line_delta
from chronolith.session import intermediate_dir
from chronolith.sources import backlog as bl
from chronolith.streaming import commits as cm, release as rl, streams as st

FRAME = "frame_id long, c string, t string, extracted_text string"
DELTA = ["frame_id", "epoch", "kept_lines", "delta_text"]


def put(spark, path, rows):
    frame = spark.createDataFrame(rows, FRAME).withColumn("frame_timestamp", F.col("t").cast("timestamp")).drop("t")
    frame.coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def made(first, n):
    return [(i, "ab"[i % 5 == 0], f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "" if i % 11 == 5 else f"line {i % 4}\n own {i // 9}\nline {i % 7}\n\nline {i % 4}") for i in range(first, first + n)]


def held(df):
    return sorted(map(tuple, df.select(*DELTA).collect()))


def test_line_delta_moves_a_table_of_texts_and_writes_no_lines(spark, tmp_path):
    frames = put(spark, f"{tmp_path}/f", made(0, 90))
    texts = frames.select("frame_id", "extracted_text").unionByName(spark.createDataFrame([(-1, "of no frame")], "frame_id long, extracted_text string"))
    files = lambda: {p.split("/")[-1].split("-")[0] for p in [str(x.getPath()) for x in spark._jvm.org.apache.hadoop.fs.Path(intermediate_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(intermediate_dir(spark)))]}
    got = held(line_delta(frames.drop("extracted_text"), "c", 300, texts))
    assert got == held(line_delta(frames, "c", 300)) and len(got) == 90
    assert "lines" not in files()


@pytest.mark.parametrize("every", [32, 2])
def test_a_stream_of_line_delta_keeps_no_state_by_context(spark, tmp_path, monkeypatch, every):
    """Five micro-batches, over which epochs go on; a late frame opens a new one."""
    monkeypatch.setattr(st.LineState.__init__, "__defaults__", (every,))
    for i in range(5):
        put(spark, f"{tmp_path}/in", made(40 * i, 40))
    in_order = put(spark, f"{tmp_path}/in", [])
    source = spark.readStream.schema(in_order.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = st.started_line_delta(source, f"{tmp_path}/q", "c", 300)
    q.awaitTermination()
    out = spark.read.schema(st.DELTA).parquet(f"{tmp_path}/q/out")
    assert held(out) == held(line_delta(in_order, "c", 300)) and all(not p["stateOperators"] for p in q.recentProgress)
    put(spark, f"{tmp_path}/in", [(1000, "a", "2024-01-01 00:00:30", "line 1"), (1001, "a", "2024-01-01 00:00:40", "line 1\nline 2")])
    st.started_line_delta(source, f"{tmp_path}/q", "c", 300).awaitTermination()
    late = {r["frame_id"]: r for r in out.sparkSession.read.schema(st.DELTA).parquet(f"{tmp_path}/q/out").collect()}
    last = max(r["epoch"] for r in late.values() if r["context"] == "a" and r["frame_id"] < 1000)
    assert (late[1000]["epoch"], late[1000]["delta_text"], late[1001]["epoch"], late[1001]["delta_text"]) == (last + 1, "line 1", last + 1, "line 2")


def test_decisions_are_judged_as_tables(spark):
    rows = [(1, "a", 1, True), (2, "a", 1, True), (3, "a", 1, True), (4, "b", 1, False), (5, "b", 1, True), (6, "c", 1, True), (7, "d", 0, True)]
    at = F.timestamp_seconds(F.col("frame_id"))
    pending = spark.createDataFrame(rows, "frame_id long, context string, attempt int, has_lines boolean").withColumns({"frame_timestamp": at, "came": F.lit(0)})
    decisions = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False), (5, True)], "frame_id long, committed boolean")
    got = {r["frame_id"]: (r["accepted"], r["open"]) for r in cm.judged(pending, decisions).collect()}
    assert got == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, False), 5: (True, False), 6: (False, True), 7: (False, False)}


def test_a_frame_that_comes_twice_is_one_frame(spark, tmp_path):
    put(spark, f"{tmp_path}/in", made(0, 20) + made(3, 1))
    read = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    run = cm.Transactions(f"{tmp_path}/tx", 300, lambda previews: previews.withColumn("failed", F.expr("frame_id = 9 AND attempt < 2")), "c")
    assert held(run.run(read)) == held(line_delta(spark.read.parquet(f"{tmp_path}/in").dropDuplicates(["frame_id"]), "c", 300))


def test_a_run_of_a_backlog_reads_its_own_pages_only(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("frame_id"), F.timestamp_seconds(F.col("id")).alias("frame_timestamp"))
    b = bl.paged(rows, f"{tmp_path}/pages", 20)

    def run(stream):
        if (tmp_path / "q").exists():
            for file in (tmp_path / "pages" / "page=0").glob("*.parquet"):
                file.write_bytes(b"no longer there")
                (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
        return st.started(stream, f"{tmp_path}/q")

    assert bl.replayed(spark, b, 1, run) == 3
    assert spark.read.parquet(f"{tmp_path}/q/out").count() == 60


class Kept:
    """A state of one value or list."""

    def __init__(self):
        self.x = None

    exists = lambda self: self.x is not None
    get = lambda self: self.x if self.x is not None else iter(())
    update = put = lambda self, x: setattr(self, "x", x)
    clear = lambda self: setattr(self, "x", None)


def test_a_key_has_one_timer_whatever_it_holds():
    timers = []
    handle = SimpleNamespace(getValueState=lambda *a: Kept(), getListState=lambda *a: Kept(), registerTimer=timers.append)
    p = rl.HeldFrames(10_000_000)
    p.init(handle)
    n = 500
    rows = pd.DataFrame({"frame_id": range(n + 1), "ts_us": [i * 1_000_000 for i in range(n + 1)], "control": [True] + [False] * n, "blocked": [True] + [None] * n})
    assert sum(map(len, p.handleInputRows(("k",), iter([rows]), None))) == 0 and timers == [11_001]
    gone = pd.concat(list(p.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 400_000), SimpleNamespace(getExpiryTimeInMs=lambda: 11_001))))
    assert gone["frame_id"].tolist() == list(range(1, 390)) and set(gone["status"]) == {"dropped"} and timers[1:] == [400_001]


def test_few_rows_of_an_arrow_batch_are_objects_at_once(spark, monkeypatch):
    made_at_once = []
    kept = pa.array
    monkeypatch.setattr(ar.pa, "array", lambda x, *a: (made_at_once.append(len(x)), kept(x, *a))[1])
    assert ar.each(lambda t, u: t and t + u, pa.string(), kept(["a", None] * 500), kept(["b"] * 1000)).to_pylist() == ["ab", None] * 500
    assert max(made_at_once) <= ar.ROWS and ar.each(len, pa.int64(), kept([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("column", [tx.nfc, lambda c: tr.prune_json(c, ["AXSecureTextField"]), lambda c: tr.holds_secure(c, ["AXSecureTextField"])])
def test_texts_and_trees_go_to_python_as_arrow(spark, column, capsys):
    spark.range(1).select(column(F.col("id").cast("string"))).explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan and ", 250" in plan.split("ArrowEvalPython")[1].split("\n")[0]  # evaluation type of an Arrow UDF


def test_only_texts_beyond_ascii_are_normalised(spark):
    rows = spark.createDataFrame([(1, "plain"), (2, "CAFE\u0301"), (3, None), (4, "")], "i int, t string")
    assert [r["n"] for r in rows.select("i", tx.nfc(F.col("t")).alias("n")).orderBy("i").collect()] == ["plain", "CAF\u00c9", None, ""]
