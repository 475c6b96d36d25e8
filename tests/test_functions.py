from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings, strategies as s
from pyspark.sql import functions as F

from chronolith.functions import code as cd, text as tx, trees as tr, values as vl
from chronolith.sources import readers


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_keyword_form_is_nfc_and_lower(spark):
    assert one(spark, tx.keyword_form(F.col("t")), t="Café") == "café"


def test_window_title_is_idempotent(spark):
    titles = ["● a.md — Edited", "** x **", "Draft (Modified)", "y [ Unsaved ]", "", "plain"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    once = df.select(tx.window_title(F.col("t")).alias("t"))
    assert [r.t for r in once.collect()] == ["a.md", "x", "draft", "y", "", "plain"]
    assert once.select(tx.window_title(F.col("t")).alias("t")).collect() == once.collect()


def test_fnv1a_of_known_values(spark):
    assert one(spark, tx.fnv1a(F.col("t")), t="") == "811c9dc5"
    assert one(spark, tx.fnv1a(F.col("t")), t="a") is not None


def test_capture_ids_round_trip(spark):
    made = tx.capture_id(F.lit("p"), F.lit(42), F.lit(""))
    assert one(spark, tx.frame_of_capture(made)) == 42
    assert one(spark, tx.frame_of_capture(F.lit("p:rec:9"))) is None


def test_frame_id_takes_integers_only(spark):
    for text, want in (("12", 12), ("-3", -3), ("1.5", None), ("x", None), ("", None)):
        assert one(spark, tx.frame_id(F.col("t")), t=text) == want


def test_lines_drop_an_empty_last_line(spark):
    assert one(spark, tx.lines(F.col("t")), t="a\r\nb\n") == ["a", "b"]
    assert one(spark, tx.lines(F.col("t")), t="") == []


def test_tokens_of_scripts():
    assert tx.token_list("fooBar ab") == ["foo", "bar"]
    assert "日本" in tx.token_list("日本語") and "日" in tx.token_list("日本語")


@given(s.text(alphabet="aAbB1_ é日", max_size=20))
@settings(max_examples=60, deadline=None)
def test_tokens_are_distinct_and_lower(text):
    found = tx.token_list(text)
    assert len(found) == len(set(found)) and all(t == t.lower() for t in found)


def test_utc_timestamp_needs_a_zone(spark):
    assert one(spark, vl.utc_timestamp(F.col("t")), t="2024-01-01T00:00:00") is None
    assert one(spark, vl.iso(vl.utc_timestamp(F.col("t"))), t="2024-01-01T08:00:00+08:00") == "2024-01-01T00:00:00.000Z"


def test_dot_uses_the_shorter_length(spark):
    assert one(spark, vl.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0), F.lit(5.0)))) == 11.0


def test_string_array_of_broken_json(spark):
    assert one(spark, vl.string_array(F.col("t")), t="not json") == []
    assert one(spark, vl.string_array(F.col("t")), t='["a", null]') == ["a"]


def test_clamp_limit():
    assert [vl.clamp_limit(x) for x in (None, float("nan"), float("inf"), -1, 0, 3.9, 500)] == [20, 20, 20, 20, 20, 3, 100]


def test_duration():
    assert [vl.duration_seconds(x) for x in ("90", "15m", "2h", "1d")] == [90, 900, 7200, 86400]
    with pytest.raises(ValueError):
        vl.duration_seconds("soon")


def test_flat_and_nested_trees_agree():
    flat = [{"role": "AXWindow", "title": "w", "depth": 0}, {"role": "AXToolbar", "depth": 1}, {"role": "AXStaticText", "text": "t", "depth": 2}, {"role": "AXTable", "text": "b", "depth": 1}]
    tree = {"role": "AXWindow", "title": "w", "children": [{"role": "AXToolbar", "children": [{"role": "AXStaticText", "text": "t"}]}, {"role": "AXTable", "text": "b"}]}
    assert tr.structured(tr.nested(flat)) == tr.structured(tree) == {"window": ["[Window] w"], "nav": ["[Nav] t"], "action": [], "body": ["[Body] b"]}


def test_hidden_subtrees_are_dropped():
    tree = {"role": "AXGroup", "children": [{"role": "AXTable", "onScreen": False, "children": [{"role": "AXStaticText", "value": "x"}]}, {"role": "AXTable", "value": "y", "bounds": {"width": 0, "height": 3}}, {"role": "AXTable", "value": "z"}]}
    assert tr.structured(tree)["body"] == ["[Body] z"]


def test_several_roots_get_an_application():
    tree = tr.nested([{"role": "AXWindow", "title": "a", "depth": 0}, {"role": "AXWindow", "title": "b", "depth": 0}])
    assert tree["role"] == "AXApplication" and tr.structured(tree)["window"] == ["[Window] a", "[Window] b"]


def test_secure_runs_in_flat_arrays():
    flat = [{"role": "AXGroup", "depth": 0}, {"role": "S", "depth": 1}, {"role": "X", "depth": 2}, {"role": "Y"}, {"role": "Z", "depth": 1}]
    assert [n["role"] for n in tr.pruned(flat, frozenset(["s"]))] == ["AXGroup", "Z"]


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"id": "1", "timestamp": "2024-01-01T00:00:00Z", "text": "a"}) + "\n" + json.dumps({"id": "2", "timestamp": "2024-01-01 00:00:00"}) + "\n")
    assert [r.id for r in readers.captures(spark, str(tmp_path / "c.json")).collect()] == ["1"]
    (tmp_path / "x.log").write_text('{"level":"warn","message":"m"}\nplain\n\n')
    assert readers.log_tail(spark, str(tmp_path / "x.log"), 10).count() == 2
    assert readers.log_tail(spark, str(tmp_path / "x.log"), 10, "warn").first()["message"] == "m"
    got = readers.folder_bytes(spark, str(tmp_path)).first()
    assert got["files"] == 2 and got["bytes"] > 0
    frames = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 0)), (2, dt.datetime(2024, 1, 1, 1, 0))], "frame_id long, frame_timestamp timestamp")
    assert readers.recent(frames, 30, "2024-01-01 01:10:00").count() == 1


def test_line_kinds_of_source_files():
    from chronolith.functions.code import kinds

    cases = {
        "a = 1 // b\n// c\n\n": (3, 1, 1, 1), "/* a\n\nb */ c\n": (3, 1, 2, 0), "x = '// no' + \"/* no */\"\n": (1, 1, 0, 0), "`a\n\n// in` // out\n": (3, 2, 0, 1),
        "": (0, 0, 0, 0), "\n": (1, 0, 0, 1), "a = 'open\n// c": (2, 1, 1, 0), "/* never\nclosed": (2, 0, 2, 0), "a\r\n\r\nb": (3, 2, 0, 1), "x = `\\`` // c\n": (1, 1, 0, 0),
    }
    for text, want in cases.items():
        assert kinds(text, ".ts") == want, text
    assert kinds("#!/bin/sh\n# c\n\nls # d\n", ".sh") == (4, 2, 1, 1)


TEXTS = ["", None, "fooBar ab", "日本語", "用户界面設計2024 fooBar", "テスト ひらがな abc漢字XyZ", "한국어 foo한bar é x", "café né", "a b c", "snake_case_1 1234 12", "日", "한", "ｱｲｳ", "𠀀𠀁x", "ÀÉ Straße ǅabc", "क़ख़"]


def test_tokens_in_the_jvm_equal_the_plain_version(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abAB_1 日本かなカ한국é́-") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.tokens(F.col("t")).alias("own"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        want = tx.token_list(texts[r["i"]] or "")
        assert sorted(r["own"]) == sorted(want), (texts[r["i"]], r["own"], want)


def test_line_kinds_of_comments_that_are_not_closed():
    assert cd.kinds("a\nconst r = /[/*]/;\nb\nc\n", ".ts") == (4, 2, 2, 0)
    assert cd.kinds("/* a\n", ".ts") == (1, 0, 1, 0) and cd.kinds("/* a\n\n", ".ts") == (2, 0, 2, 0) and cd.kinds("`a\n", ".ts") == (1, 1, 0, 0)
    assert cd.kinds("", ".ts") == (0, 0, 0, 0) and cd.kinds("\n", ".ts") == (1, 0, 0, 1) and cd.kinds("x\r\n\r\n// y", ".ts") == (3, 1, 1, 1)


def test_trees_of_any_depth_end_no_task(spark):
    def chain(depth, leaf):
        return '{"role":"AXGroup","children":[' * depth + leaf + "]}" * depth

    texts = [chain(2_000, '{"role":"AXSecureTextField","value":"pw"},{"role":"AXStaticText","value":"kept"}'), chain(200_000, '{"role":"AXSecureTextField","value":"pw"}'), "[" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", tr.prune_json(F.col("t"), ["AXSecureTextField"]).alias("p"), tr.tree_text(F.col("t"), F.lit(None).cast("string")).alias("x")).orderBy("i").collect()
    assert "pw" not in (got[0]["p"] or "") and "kept" in (got[0]["p"] or "kept")
    assert got[1]["p"] is None and got[2]["p"] is None and "kept" in got[0]["x"] and got[1]["x"] == got[2]["x"] == ""


def test_a_log_is_read_from_its_end(spark, tmp_path):
    line = lambda i: json.dumps({"level": "error" if i % 100 == 0 else "info", "message": f"né {i}", "pad": "x" * 60})
    (tmp_path / "a.log").write_text("\n".join(line(i) for i in range(30_000)) + "\n\n")
    got, read = readers.tail_lines(spark, str(tmp_path / "a.log"), 50, chunk=4096)
    assert got == [line(i) for i in range(29_950, 30_000)] and read <= 3 * 4096
    assert [r["message"] for r in readers.log_tail(spark, str(tmp_path / "a.log"), 3).collect()] == ["né 29999", "né 29998", "né 29997"]
    errors = readers.log_tail(spark, str(tmp_path / "a.log"), 2, level="ERROR").collect()
    assert [r["message"] for r in errors] == ["né 29900", "né 29800"]
    (tmp_path / "b.log").write_text("plain\r\n  \nlast")  # the newer file, without an end of its last line
    assert readers.tail_lines(spark, str(tmp_path), 3)[0] == [line(29_999), "plain", "last"]
    assert readers.tail_lines(spark, str(tmp_path / "a.log"), 10**6, most=10_000)[1] == 10_000
    assert readers.tail_lines(spark, str(tmp_path / "none.log"), 5) == ([], 0) and readers.log_tail(spark, str(tmp_path / "none.log")).count() == 0
