"""Frames of blocked keys are held back, and released in order once a control row unblocks them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RELEASED = "key string, frame_id long, ts_us long, status string, released_us long, place long"


class HeldFrames(StatefulProcessor):
    """Per key: whether it is blocked, the frames held, and how many have been let through.

    A control row blocks (true), unblocks (false), or can't be read (null): then the key counts as blocked. A held frame is given up once it is
    older than `hold_us`: by a timer on event time, or when the key is unblocked too late. A key has one timer, for the oldest frame that it holds: it
    gives up all that are too old, and is set again for the next one.
    """

    def __init__(self, hold_us: int):
        self.hold_us = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "blocked boolean, passed long")
        self.held = handle.getListState("held", "frame_id long, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([part[["frame_id", "ts_us", "control", "blocked"]] for part in rows]).sort_values(["ts_us", "frame_id"])  # no texts: four columns of one key of one micro-batch
        blocked, passed = self.state.get() if self.state.exists() else (False, 0)
        held = [tuple(x) for x in self.held.get()]
        out = []
        for frame, us, control, says in zip(batch["frame_id"].tolist(), batch["ts_us"].tolist(), batch["control"].tolist(), batch["blocked"].tolist(), strict=True):
            if control:
                blocked = says is None or says != says or bool(says)
            elif blocked:
                held.append((frame, us))
            else:
                out.append((frame, us, "passed", us, passed))
                passed += 1
            if control and not blocked:
                for old, at in held:
                    late = us - at > self.hold_us
                    out.append((old, at, "dropped" if late else "released", None if late else us, None if late else passed))
                    passed += not late
                held = []
        self._keep(held, blocked, passed)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(x) for x in self.held.get()]
        given_up = [(frame, us, "dropped", None, None) for frame, us in held if us + self.hold_us < now]
        self._keep([x for x in held if x[1] + self.hold_us >= now], *self.state.get())
        yield self._rows(key, given_up)

    def _keep(self, held: list, blocked: bool, passed: int) -> None:
        self.state.update((bool(blocked), int(passed)))
        self.held.clear()
        if held:
            self.held.put([(int(frame), int(us)) for frame, us in held])
            self.handle.registerTimer((min(int(us) for _, us in held) + self.hold_us) // 1000 + 1)

    @staticmethod
    def _rows(key, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["frame_id", "ts_us", "status", "released_us", "place"]).astype({"released_us": "Int64", "place": "Int64"})
        out.insert(0, "key", str(key[0]))
        return out

    def close(self) -> None:
        pass


def stream_released(frames: DataFrame, controls: DataFrame, key: str, hold: int, delay: str = "0 seconds") -> DataFrame:
    """(key, frame_id, ts_us, status, released_us, place) of a stream of frames (key, frame_id, frame_timestamp) under a stream of controls (the same and blocked).

    status: passed at once, released by the control row at released_us, or dropped after `hold` seconds; frames still held have no row. place counts what a key lets through. Rows of
    one micro-batch take effect in order of time and id, those of earlier ones before. Of a control row that can't be read blocked is null. Needs the RocksDB state store.
    """
    own = lambda df, control, blocked: df.select(F.col(key).cast("string").alias("key"), "frame_id", "frame_timestamp", F.lit(control).alias("control"), blocked.cast("boolean").alias("blocked"))
    both = own(frames, False, F.lit(None)).unionByName(own(controls, True, F.col("blocked")))
    rows = both.withColumn("ts_us", F.unix_micros("frame_timestamp")).withWatermark("frame_timestamp", delay)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=HeldFrames(hold * 1_000_000), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")
