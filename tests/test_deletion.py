"""Deletion as a whole: counts, tombstones, retries, retention."""

import datetime as dt

from pyspark.sql import functions as F

from chronolith.operators import deletion as de, privacy as pr

NOW = "2024-02-01 00:00:00"


def tables(spark):
    at = lambda i: dt.datetime(2024, 1, 1 + i)
    frames = spark.createDataFrame([(i, at(i), 100) for i in range(10)], "frame_id long, frame_timestamp timestamp, bytes long")
    elements = spark.createDataFrame([(i, j) for i in range(10) for j in range(3)], "frame_id long, n int")
    sessions = spark.createDataFrame([("a", [0, 1, 2]), ("b", [3, 4]), ("c", [9])], "session_id string, evidence_frame_ids array<long>")
    vectors = spark.createDataFrame([("extracted:1", None, ""), ("x", 2, ""), ("y", None, "p:frame:3"), ("extracted:8", None, "")], "id string, meta_frame_id long, capture_id string")
    return frames, elements, lambda ids: de.derived_deleted(sessions, frames.select("frame_id"), vectors, ids)


def none_noted(spark):
    return spark.createDataFrame([], de.TOMBSTONE)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "frame_id long")


def test_counts_ride_on_the_rewrite(spark):
    frames, elements, derived = tables(spark)
    left, noted, failed = de.cascaded(frames, elements, ids(spark, 1, 2, 2, 77), derived, NOW, none_noted(spark))
    assert failed is None and noted.count() == 0
    assert left.counts == {"frames": 2, "elements": 6, "sessions": 1, "content": 2, "vectors": 2}
    assert {k: t.count() for k, t in left.tables.items()} == {"frames": 8, "elements": 24, "sessions": 2, "content": 8, "vectors": 2}
    nothing, _, _ = de.cascaded(frames, elements, ids(spark).limit(0), derived, NOW, none_noted(spark))
    assert set(nothing.counts.values()) == {0}


def test_a_failed_cascade_is_noted_and_tried_until_it_works(spark):
    frames, elements, derived = tables(spark)

    def broken(_):
        raise OSError("locked")

    left, noted, failed = de.cascaded(frames, elements, ids(spark, 3, 5), broken, NOW, none_noted(spark))
    assert failed == "Cascade_Delete failed: locked" and left.counts == {"frames": 2, "elements": 6}
    row = noted.first()
    assert (row["from"], row["to"], row["failed_frame_ids"], row["resolved_at"]) == (dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 6), [3, 5], None)
    again, resolved = de.reconciled(noted, broken, NOW)
    assert resolved == 0 and pr.unresolved(again).count() == 1
    done, resolved = de.reconciled(again, derived, "2024-02-03")
    assert resolved == 1 and pr.unresolved(done).count() == 0 and done.first()["resolved_at"] == dt.datetime(2024, 2, 3)
    assert de.reconciled(done, broken, NOW)[1] == 0


def test_retention_deletes_whole_batches_down_to_the_floor(spark):
    frames, elements, derived = tables(spark)
    left, _, over = de.retained(frames, elements, 450, "2024-01-09", derived, NOW, none_noted(spark), batch=2)
    assert left.counts["frames"] == 6 and left.counts["sessions"] == 2 and not over
    left, _, over = de.retained(frames, elements, 450, "2024-01-03", derived, NOW, none_noted(spark), batch=2)
    assert left.counts["frames"] == 2 and over
    assert sorted(r["frame_id"] for r in left.tables["frames"].select(F.col("frame_id")).collect()) == list(range(2, 10))
