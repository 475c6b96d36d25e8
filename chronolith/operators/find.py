"""`find` as a whole: a bounded search, sessions of the hits, suppressed times, groups and a narrative."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import narratives
from ..functions.values import clamp_limit
from . import search as se, sessions as ss

SCAN_BUDGET = 500_000
NO_EMBEDDING = "embedding provider unavailable"


@dataclass(frozen=True)
class Found:
    """hits (rank, frame columns, session_id), groups by session, a row of narrative, and why the result is less than what was asked for."""

    hits: DataFrame
    groups: DataFrame
    narrative: DataFrame
    degraded: dict[str, str] | None


def find(
    frames: DataFrame, activity: DataFrame, keys: list[str], query: str, *, idle: int = ss.IDLE_SECONDS, start=None, end=None, app: str | None = None, limit: float | None = None,
    mode: str = "keyword", vectors: DataFrame | None = None, query_vector: list[float] | None = None, suppressed: DataFrame | None = None, budget: int = SCAN_BUDGET, normalised: bool = False,
) -> Found:
    """Frames that match a query, newest or nearest first.

    mode is keyword, semantic or hybrid; without a query vector or vectors the latter two search by keyword, and semantic says so. Rows in a
    suppressed range go after the limit, so a page may come out short. A keyword search that meets its scan budget before its limit says so.
    """
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"mode is keyword, semantic or hybrid, not {mode!r}")
    degraded, top = None, clamp_limit(limit)
    eligible = se.bounded(frames, start, end, app)
    if mode != "keyword" and vectors is not None and query_vector is not None:
        near = se.nearest(se.bounded(vectors, start, end, app, text=None), query_vector, 2 * top)
        hits = se.held(se.resolved(near.select("id", "score"), eligible, top))
        order = [F.desc("score"), F.asc("frame_id")]
    else:
        if mode == "semantic":
            degraded = {"requested_mode": mode, "actual_mode": "keyword", "reason": NO_EMBEDDING}
        scanned, cut = se.within_budget(eligible, budget)
        hits = se.held(se.newest(se.matching(scanned, query, normalised=normalised), top))
        if cut and degraded is None and hits.count() < top:
            degraded = {"requested_mode": mode, "actual_mode": "keyword", "reason": f"keyword scan truncated at {budget} rows; narrow the time window for a complete result"}
        order = [F.desc("frame_timestamp"), F.desc("frame_id")]
    owners = ss.sessionized(se.of_keys(activity, hits, keys), keys, idle).select("frame_id", "session_id")
    owned = se.with_sessions(se.ranks(hits, *order), owners)
    shown = owned if suppressed is None else se.without_suppressed_points(owned, suppressed)
    return Found(shown, se.grouped_by_session(shown), narratives.of_hits(shown), degraded)
