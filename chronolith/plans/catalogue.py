"""Every query by name, and its SQL where SQL can express it. Times are given in microseconds, so that both engines hash alike."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import code as cd, narratives as nv, text as tx, values as vl
from ..operators import deletion as de, diagnostics as dg, find as fi, ingest as ig, intervals as iv, lifecycle as lc, pool as po, privacy as pr, routines as rt, search as se, sessions as ss, summaries as su
from ..functions import trees as tr
from ..operators.linedelta import line_columns, line_delta
from ..session import intermediate_dir
from ..sources import backlog as bl, readers as rd
from ..streaming import commits as cm, release as rl, streams as st
from .views import FRAMES_SQL, IDLE, NUMBERED_SQL, USER, activity, frames, rows, table, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def _texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), F.col("text").alias("extracted_text"))


def numbered(spark, d) -> DataFrame:
    return ss.sessionized(activity(spark, d), USER, IDLE)


def sessions(spark, d) -> DataFrame:
    return ss.sessions_of(numbered(spark, d), USER)


# --- search ---------------------------------------------------------------------------------------------------

QUERY_VECTOR = [((i * 37) % 64 - 32) / 100.0 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
SCORES_SQL = f"""scored AS (SELECT v.vec_id, 'extracted:' || v.vec_id AS id, e.event_type AS app_name, round(list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::DOUBLE * ({VECTOR_SQL})[i])), 6) AS score
  FROM embeddings v JOIN events e ON v.vec_id = e.event_id)"""

HIT = ["frame_id", "app_name"]


def _hits(spark, d, **kw) -> DataFrame:
    return se.newest(se.matching(frames(spark, d), "tion", normalised=True, **kw), 20)


def _owned(spark, d, hits) -> DataFrame:
    """Held hits with their sessions, which only their users' activity is needed for."""
    own = ss.sessionized(se.of_keys(activity(spark, d), hits, USER), USER, IDLE).select("frame_id", "session_id")
    return se.with_sessions(hits, own)


@query(f"WITH {FRAMES_SQL} SELECT frame_id, app_name, epoch_us(frame_timestamp) AS ts_us FROM frames WHERE lower(extracted_text) LIKE '%tion%' AND extracted_text <> '' AND app_name = 'click' AND frame_timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20' ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 20")
def find_keyword(spark, d):
    return _hits(spark, d, app="click", start="2024-01-01 00:00:00", end="2024-01-20 00:00:00").select(*HIT, us("frame_timestamp").alias("ts_us"))


@query(f"WITH {FRAMES_SQL} SELECT frame_id, app_name FROM frames WHERE lower(extracted_text) LIKE '%tion%' AND (frame_timestamp < TIMESTAMP '2024-01-02 12:00:00' OR (frame_timestamp = TIMESTAMP '2024-01-02 12:00:00' AND frame_id < 500)) ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 20")
def find_keyword_paged(spark, d):
    return se.newest(se.matching(frames(spark, d), "tion", normalised=True), 20, ("2024-01-02 12:00:00", 500)).select(*HIT)


@query(f"WITH {FRAMES_SQL} SELECT count(*) AS eligible, least(count(*), 500) AS scanned, count(*) > 500 AS truncated FROM frames WHERE extracted_text <> ''")
def find_scan_truncated(spark, d):
    return se.scan_state(frames(spark, d).filter("extracted_text <> ''"), 500)


@query(f"""WITH {FRAMES_SQL}, {NUMBERED_SQL}, hits AS (SELECT frame_id, app_name FROM frames WHERE lower(extracted_text) LIKE '%tion%' ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 20)
SELECT h.frame_id, h.app_name, o.session_id FROM hits h LEFT JOIN owned o USING (frame_id)""")
def find_with_session(spark, d):
    return _owned(spark, d, se.held(_hits(spark, d))).select(*HIT, "session_id")


@query(f"""WITH {FRAMES_SQL}, {NUMBERED_SQL}, hits AS (SELECT frame_id, row_number() OVER (ORDER BY frame_timestamp DESC, frame_id DESC) - 1 AS rank FROM frames WHERE lower(extracted_text) LIKE '%tion%' ORDER BY rank LIMIT 20)
SELECT session_id, min(rank) AS first_rank, string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY rank) AS frame_ids FROM hits JOIN owned USING (frame_id) GROUP BY session_id""")
def find_group_by_session(spark, d):
    hits = se.held(se.ranks(_hits(spark, d), F.desc("frame_timestamp"), F.desc("frame_id")))
    return se.grouped_by_session(_owned(spark, d, hits)).select("session_id", "first_rank", F.array_join(F.col("frame_ids").cast("array<string>"), ",").alias("frame_ids"))


@query(f"""WITH {FRAMES_SQL}, {NUMBERED_SQL}, hits AS (SELECT frame_id, app_name FROM frames WHERE lower(extracted_text) LIKE '%tion%' ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 20),
o AS (SELECT h.app_name, session_id FROM hits h LEFT JOIN owned USING (frame_id)), a AS (SELECT app_name, count(*) AS n FROM o GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS hits, '找到 ' || CAST(sum(n) AS BIGINT) || ' 条证据，分布在 ' || (SELECT count(DISTINCT session_id) FROM o) || ' 个会话中（' || string_agg(app_name || ': ' || n, ', ' ORDER BY n DESC, app_name) || ' 应用）。' AS narrative FROM a""")
def find_narrative(spark, d):
    return nv.of_hits(_owned(spark, d, se.held(_hits(spark, d))))


@query(f"""WITH {FRAMES_SQL}, {NUMBERED_SQL}, ranges(f, t) AS (VALUES (TIMESTAMP '2024-01-01 04:00:00', TIMESTAMP '2024-01-01 06:00:00')),
hits AS (SELECT frame_id, app_name, frame_timestamp, CAST(row_number() OVER (ORDER BY frame_timestamp DESC, frame_id DESC) - 1 AS BIGINT) AS rank FROM frames
  WHERE lower(extracted_text) LIKE '%tion%' AND extracted_text <> '' AND frame_timestamp BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-20' ORDER BY rank LIMIT 40)
SELECT rank, frame_id, h.app_name, session_id FROM hits h LEFT JOIN owned USING (frame_id) WHERE NOT EXISTS (SELECT 1 FROM ranges WHERE frame_timestamp BETWEEN f AND t)""")
def find_composed(spark, d):
    ranges = rows(spark, [("2024-01-01 04:00:00", "2024-01-01 06:00:00")], "f string, t string").select(F.col("f").cast("timestamp").alias("from"), F.col("t").cast("timestamp").alias("to"))
    found = fi.find(frames(spark, d), activity(spark, d), USER, "TION", idle=IDLE, start="2024-01-01 01:00:00", end="2024-01-20 00:00:00", limit=40, suppressed=ranges)
    return found.hits.select("rank", "frame_id", "app_name", "session_id")


@query(f"""WITH {FRAMES_SQL}, {NUMBERED_SQL}, scanned AS (SELECT * FROM frames WHERE extracted_text <> '' ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 60),
hits AS (SELECT * FROM scanned WHERE lower(extracted_text) LIKE '%tion%' ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 100)
SELECT h.frame_id, session_id, 'keyword scan truncated at 60 rows; narrow the time window for a complete result' AS reason FROM hits h LEFT JOIN owned USING (frame_id)""")
def find_within_budget(spark, d):
    found = fi.find(frames(spark, d), activity(spark, d), USER, "tion", idle=IDLE, limit=100, budget=60, normalised=True)
    return found.hits.select("frame_id", "session_id", F.lit((found.degraded or {}).get("reason")).alias("reason"))


@query(f"""WITH {SCORES_SQL}, {FRAMES_SQL}, {NUMBERED_SQL}, top AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 20)
SELECT frame_id, score, session_id FROM (SELECT frame_id, score FROM top JOIN frames ON frames.frame_id = top.vec_id WHERE extracted_text <> '' ORDER BY score DESC, frame_id LIMIT 10) LEFT JOIN owned USING (frame_id)""")
def find_semantic_composed(spark, d):
    found = fi.find(frames(spark, d), activity(spark, d), USER, "", idle=IDLE, limit=10, mode="semantic", vectors=vectors(spark, d), query_vector=QUERY_VECTOR)
    return found.hits.select("frame_id", "score", "session_id")


# é and composed Hangul, as they are and taken apart
@query(f"""WITH {FRAMES_SQL}, t AS (SELECT frame_id, extracted_text || CASE frame_id % 3 WHEN 0 THEN ' Caf' || chr(233) || ' ' WHEN 1 THEN ' CAFE' || chr(769) || ' ' ELSE ' cafe ' END AS x, frame_timestamp FROM frames)
SELECT frame_id FROM t WHERE lower(nfc_normalize(x)) LIKE '%caf' || chr(233) || '%' ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 50""")
def find_keyword_nfc(spark, d):
    mark = F.when(F.col("frame_id") % 3 == 0, " Caf\u00e9 ").when(F.col("frame_id") % 3 == 1, " CAFE\u0301 ").otherwise(" cafe ")
    marked = frames(spark, d).withColumn("extracted_text", F.concat("extracted_text", mark))
    return se.newest(se.matching(marked, "cafe\u0301"), 50).select("frame_id")


def _ranges(spark):
    return rows(spark, [("2024-01-02 00:00:00", "2024-01-03 06:00:00"), ("2024-01-28 00:00:00", "2024-01-29 12:00:00")], "f string, t string").select(F.col("f").cast("timestamp").alias("from"), F.col("t").cast("timestamp").alias("to"))


RANGES_SQL = "ranges(f, t) AS (VALUES (TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03 06:00:00'), (TIMESTAMP '2024-01-28', TIMESTAMP '2024-01-29 12:00:00'))"


@query(f"""WITH {FRAMES_SQL}, {RANGES_SQL}, hits AS (SELECT * FROM frames WHERE lower(extracted_text) LIKE '%tion%' ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 20)
SELECT frame_id, app_name FROM hits WHERE NOT EXISTS (SELECT 1 FROM ranges WHERE frame_timestamp BETWEEN f AND t)""")
def find_suppressed(spark, d):
    return se.without_suppressed_points(_hits(spark, d), _ranges(spark)).select(*HIT)


@query(f"WITH {SCORES_SQL} SELECT id, app_name, score FROM scored WHERE app_name <> 'error' ORDER BY score DESC, id LIMIT 10")
def find_semantic_topk(spark, d):
    return se.nearest(vectors(spark, d).filter("app_name <> 'error'"), QUERY_VECTOR, 10).select("id", "app_name", "score")


@query(f"WITH {SCORES_SQL}, top AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 20), {FRAMES_SQL} SELECT frame_id, score FROM top JOIN frames ON frames.frame_id = top.vec_id WHERE lang <> 'fr' ORDER BY score DESC, frame_id LIMIT 10")
def find_semantic_overfetch(spark, d):
    hits = se.nearest(vectors(spark, d), QUERY_VECTOR, 20).select("id", "score")
    return se.resolved(hits, frames(spark, d).filter("lang <> 'fr'"), 10).select("frame_id", "score")


@query(f"""WITH {SCORES_SQL}, {FRAMES_SQL}, s AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM scored ORDER BY rank LIMIT 50),
k AS (SELECT frame_id AS id, row_number() OVER (ORDER BY frame_timestamp DESC, frame_id DESC) - 1 AS rank FROM frames WHERE lower(extracted_text) LIKE '%tion%' ORDER BY rank LIMIT 50)
SELECT id, round(coalesce(1.0::DOUBLE / (60 + k.rank + 1), 0) + coalesce(1.0::DOUBLE / (60 + s.rank + 1), 0), 6) AS score,
  CASE WHEN k.id IS NOT NULL AND s.id IS NOT NULL THEN 'hybrid' WHEN k.id IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS source
FROM k FULL JOIN s USING (id) ORDER BY score DESC, id LIMIT 10""")
def rrf_fusion(spark, d):
    semantic = se.ranks(se.nearest(vectors(spark, d), QUERY_VECTOR, 50), F.desc("score"), F.asc("id")).select(F.col("vec_id").alias("id"), "rank")
    keyword = se.newest(se.matching(frames(spark, d), "tion", normalised=True), 50)
    keyword = se.ranks(keyword, F.desc("frame_timestamp"), F.desc("frame_id")).select(F.col("frame_id").alias("id"), "rank")
    return se.fused(keyword, semantic, 10)


@query(f"""WITH {FRAMES_SQL}, h AS (SELECT frame_id, sha256(extracted_text) AS h FROM frames), cache AS (SELECT DISTINCT sha256(d.text) AS h FROM documents d WHERE d.doc_id % 3 = 0)
SELECT frame_id, h AS text_hash, cache.h IS NOT NULL AS cached FROM h LEFT JOIN cache USING (h)""")
def embedding_cache_join(spark, d):
    cache = table(spark, d, "documents").filter("doc_id % 3 = 0").select(tx.text_hash(F.col("text")).alias("hash")).distinct().withColumn("embedding", F.array(F.lit(0.1)))
    hashed = frames(spark, d).withColumn("text_hash", tx.text_hash(F.col("extracted_text")))
    return ig.with_cached_embeddings(hashed, cache).select("frame_id", "text_hash", F.col("embedding").isNotNull().alias("cached"))


# --- sessions -------------------------------------------------------------------------------------------------


@query(f"WITH {NUMBERED_SQL} SELECT frame_id, user_id, session_id FROM owned")
def sessionize_gap(spark, d):
    return numbered(spark, d).select("frame_id", "user_id", "session_id")


@query(f"WITH {NUMBERED_SQL} SELECT session_id, frames, round(active, 6) AS active_seconds, epoch_us(started_at) AS started_us, epoch_us(ended_at) AS ended_us FROM sessions")
def session_active_seconds(spark, d):
    return sessions(spark, d).select("session_id", "frames", r6(F.col("active_seconds")).alias("active_seconds"), us("started_at").alias("started_us"), us("ended_at").alias("ended_us"))


@query(f"WITH {NUMBERED_SQL} SELECT user_id, epoch_us(started_at) AS started_us, frames FROM sessions")
def session_window_equiv(spark, d):
    w = activity(spark, d).groupBy("user_id", F.session_window("frame_timestamp", f"{IDLE} seconds")).agg(F.count("*").alias("frames"))
    return w.select("user_id", us("session_window.start").alias("started_us"), "frames")


@query(f"WITH {NUMBERED_SQL} SELECT session_id, NOT (ended_at < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 14400 SECOND) AS is_open FROM sessions")
def session_idle_flush(spark, d):
    now = F.lit("2024-01-30 20:00:00").cast("timestamp")
    return ss.idle_flushed(sessions(spark, d), now, IDLE).select("session_id", "is_open")


@query(f"WITH {NUMBERED_SQL} SELECT user_id, arg_max(session_id, ended_at) AS session_id FROM sessions WHERE NOT (ended_at < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 14400 SECOND) GROUP BY 1")
def session_open_lookup(spark, d):
    now = F.lit("2024-01-30 20:00:00").cast("timestamp")
    return ss.open_session_for(ss.idle_flushed(sessions(spark, d), now, IDLE), USER).select("user_id", "session_id")


@query(f"WITH {NUMBERED_SQL} SELECT session_id, epoch_us(started_at) AS started_us FROM sessions WHERE started_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15' ORDER BY started_at DESC, session_id LIMIT 50 OFFSET 10")
def session_list(spark, d):
    out = ss.session_list(sessions(spark, d), *[F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-15")], limit=50, offset=10)
    return out.select("session_id", us("started_at").alias("started_us"))


@query(f"WITH {NUMBERED_SQL} SELECT session_id, CAST(floor(active + 0.5) AS BIGINT) AS active_seconds FROM sessions")
def recall_sessions(spark, d):
    return ss.recall_sessions(sessions(spark, d)).select("session_id", "active_seconds")


@query(f"WITH {NUMBERED_SQL}, {RANGES_SQL} SELECT session_id, CAST(floor(active + 0.5) AS BIGINT) AS active_seconds FROM sessions WHERE NOT EXISTS (SELECT 1 FROM ranges WHERE ended_at >= f AND started_at <= t)")
def recall_sessions_overlap_filter(spark, d):
    return ss.recall_sessions(sessions(spark, d), _ranges(spark)).select("session_id", "active_seconds")


def _block_sql(unit: str, app: str = "") -> str:
    return f"""WITH {NUMBERED_SQL}, s AS (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, frame_id) AS nx FROM owned)
SELECT epoch_us(date_trunc('{unit}', ts)) AS bucket_us{", app_name" if app else ""}, count(DISTINCT session_id) AS sessions,
  CAST(sum(CASE WHEN nx IS NULL THEN 1 ELSE floor(least(greatest((epoch_us(nx) - epoch_us(ts)) / 1e6, 0), 14400)) END) AS BIGINT) AS seconds FROM s GROUP BY ALL"""


@query(_block_sql("hour"))
def recall_hour(spark, d):
    return ss.recall_totals(numbered(spark, d), "hour", IDLE).select(us(F.col("bucket_start").cast("timestamp")).alias("bucket_us"), "sessions", "seconds")


@query(_block_sql("day"))
def recall_day(spark, d):
    return ss.recall_totals(numbered(spark, d), "day", IDLE).select(us(F.col("bucket_start").cast("timestamp")).alias("bucket_us"), "sessions", "seconds")


@query(_block_sql("day", "app"))
def recall_by_app(spark, d):
    return ss.recall_blocks(numbered(spark, d), "day", IDLE).select(us(F.col("bucket_start").cast("timestamp")).alias("bucket_us"), "app_name", "sessions", "seconds")


@query(f"WITH {NUMBERED_SQL} SELECT epoch_us(date_trunc('day', s.started_at)) AS bucket_us, count(*) AS seconds FROM sessions s JOIN owned o USING (session_id) WHERE o.frame_id % 7 = 0 GROUP BY 1")
def recall_missing_evidence(spark, d):
    left = activity(spark, d).filter("frame_id % 7 <> 0")
    return ss.missing_evidence_seconds(sessions(spark, d), left, "day").select(us("bucket_start").alias("bucket_us"), "seconds")


@query(f"""WITH {NUMBERED_SQL} SELECT session_id, frame_id, app_name, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, frame_id) - 1 AS INTEGER) AS position FROM owned WHERE session_id IN ('1#0', '2#1', '7#3')""")
def inspect_session_evidence(spark, d):
    return ss.session_evidence(sessions(spark, d), activity(spark, d), ["1#0", "2#1", "7#3"]).select("session_id", "frame_id", "app_name", "position")


@query(f"WITH {NUMBERED_SQL} SELECT frame_id, session_id FROM owned")
def frame_owner_map(spark, d):
    return ss.frame_owners(sessions(spark, d))


# --- narratives ---------------------------------------------------------------------------------------------------


def _told(spark, d) -> DataFrame:
    """Sessions with the app of their first frame as app and label."""
    return ss.sessions_of(numbered(spark, d), USER, first=("app_name",)).withColumn("context_label", F.concat("app_name", F.lit(" work")))


TOLD_SQL = f"""{NUMBERED_SQL}, told AS (SELECT s.*, o.app_name AS app FROM sessions s JOIN (SELECT session_id, arg_min(app_name, {{'t': ts, 'i': frame_id}}) AS app_name FROM owned GROUP BY 1) o USING (session_id)),
iso AS (SELECT *, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS a, strftime(ended_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS b FROM told)"""


@query(f"""WITH {TOLD_SQL} SELECT session_id, '会话 ' || app || ' | ' || app || ' work（' || a || ' → ' || b || '，' || greatest(1, CAST(floor(active / 60 + 0.5) AS BIGINT)) || ' 分钟，' || frames || ' 帧）。' AS narrative FROM iso""")
def session_narratives(spark, d):
    c = [F.col(x) for x in ("app_name", "context_label", "started_at", "ended_at", "active_seconds", "frames")]
    return _told(spark, d).select("session_id", nv.session(*c).alias("narrative"))


@query(f"""WITH {TOLD_SQL} SELECT session_id, '在 ' || app || ' 中工作约 ' || CAST(floor(active / 60 + 0.5) AS BIGINT) || ' 分钟，围绕 "' || app || ' work"，共 ' || frames || ' 帧证据（' || a || '起，' || b || '止）。' AS summary_text, 'degraded' AS summary_status FROM iso""")
def summary_template(spark, d):
    return ss.summary_text(_told(spark, d)).select("session_id", "summary_text", "summary_status")


@query(f"""WITH {TOLD_SQL} SELECT count(*) AS sessions, '在 2024-01-01 至 2024-02-01 内有 ' || count(*) || ' 个会话，覆盖 ' || (SELECT string_agg(app, ', ' ORDER BY app) FROM (SELECT DISTINCT app FROM told)) || ' 应用，总活跃 ' || CAST(floor(sum(active) / 60 + 0.5) AS BIGINT) || ' 分钟。' AS narrative FROM told""")
def recall_narrative(spark, d):
    return nv.of_sessions(_told(spark, d), "2024-01-01", "2024-02-01")


@query(f"""WITH b AS ({_block_sql("day")}), a AS ({_block_sql("day", "app")}), n AS (SELECT bucket_us, string_agg(app_name || ': ' || CAST(floor(seconds / 60 + 0.5) AS BIGINT) || ' 分', '；' ORDER BY seconds DESC, app_name) AS apps FROM a GROUP BY 1)
SELECT bucket_us, '该时段共 ' || sessions || ' 个会话（' || apps || '），活跃 ' || CAST(floor(seconds / 60 + 0.5) AS BIGINT) || ' 分钟。' AS narrative FROM b JOIN n USING (bucket_us)""")
def block_narratives(spark, d):
    n = numbered(spark, d)
    apps = ss.recall_blocks(n, "day", IDLE).groupBy("bucket_start").agg(F.collect_list(F.struct(F.col("app_name").alias("name"), "seconds")).alias("apps"))
    out = ss.recall_totals(n, "day", IDLE).join(apps, "bucket_start")
    return out.select(us(F.col("bucket_start").cast("timestamp")).alias("bucket_us"), nv.block(F.col("sessions"), F.col("seconds"), F.col("apps")).alias("narrative"))


@query(f"""WITH {NUMBERED_SQL}, s AS (SELECT *, NOT (ended_at < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 14400 SECOND) AS is_open, CASE frames % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'degraded' END AS st FROM sessions)
SELECT epoch_us(max(ended_at) FILTER (NOT is_open)) AS last_closed_us, count(*) FILTER (is_open) AS open, count(*) FILTER (started_at >= TIMESTAMP '2024-01-10') AS started_since, count(*) FILTER (st = 'ready') AS ready, count(*) FILTER (st = 'pending') AS pending, count(*) FILTER (st IN ('failed', 'degraded')) AS failed FROM s""")
def session_counts(spark, d):
    s = ss.idle_flushed(sessions(spark, d), F.lit("2024-01-30 20:00:00").cast("timestamp"), IDLE)
    s = s.withColumn("summary_status", F.expr("CASE frames % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'degraded' END"))
    return ss.counts(s, "2024-01-10 00:00:00").select(us("last_closed").alias("last_closed_us"), "open", "started_since", "ready", "pending", "failed")


# --- line delta, context ------------------------------------------------------------------------------------------


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT *, (epoch_us(frame_timestamp) - epoch_us(lag(frame_timestamp) OVER w)) / 1e6 AS gap, row_number() OVER w AS seq FROM frames WINDOW w AS (PARTITION BY lang ORDER BY frame_timestamp, frame_id)),
p AS (SELECT *, sum(CASE WHEN gap <= 14400 THEN 0 ELSE 1 END) OVER (PARTITION BY lang ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM g),
l AS (SELECT frame_id, lang, epoch, seq, i AS pos, trim(s[i]) AS line FROM (SELECT *, string_split(extracted_text, chr(10)) AS s FROM p), unnest(range(1, len(s) + 1)) AS u(i) WHERE trim(s[i]) <> ''),
f AS (SELECT *, min(seq) OVER (PARTITION BY lang, epoch, line) AS first FROM l),
k AS (SELECT frame_id, count(*) AS kept_lines, string_agg(line, chr(10) ORDER BY pos) AS t FROM f WHERE seq = first GROUP BY 1)
SELECT p.frame_id, p.lang, CAST(p.epoch AS BIGINT) AS epoch, coalesce(k.kept_lines, 0) AS kept_lines, coalesce(k.t, '') AS delta_text, sha256(k.t) AS delta_hash FROM p LEFT JOIN k USING (frame_id)""")
def line_delta_batch(spark, d):
    return line_delta(frames(spark, d), "lang", IDLE, _texts(spark, d))


#: A title of each document with an editor's marks, in the SQL of both engines.
TITLE = """CASE doc_id % 9 WHEN 0 THEN '● ' || source || ' — Edited' WHEN 1 THEN '** ' || source || ' **' WHEN 2 THEN upper(source) || ' (Modified)' WHEN 3 THEN source || ' [ unsaved ]'
  WHEN 4 THEN '  ' || source || ' ' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '•' || source || '◆' || lang || '●' ELSE source END"""
TITLED_SQL = f"t AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN lang END AS app, {TITLE} AS t FROM documents)"


def _titled(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 10 <> 0 THEN lang END").alias("app"), F.expr(TITLE).alias("title"))


def _values(values: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, v)) + ")" for v in values)


_T = "trim(replace(replace(replace(trim(coalesce(t, '')), '•', ''), '●', ''), '◆', ''))"
for _p in (r"^\s*\*+", r"\*+\s*$", r"(?i)\(\s*modified\s*\)\s*$", r"(?i)\[\s*unsaved\s*\]\s*$", r"^\s*●\s*", r"(?i)\s*—\s*edited$"):
    _T = f"trim(regexp_replace({_T}, '{_p}', ''))"


@query(f"WITH {TITLED_SQL} SELECT doc_id, coalesce(app, '') || '::' || lower({_T}) AS context_key FROM t")
def context_key(spark, d):
    return _titled(spark, d).select("doc_id", tx.context_key(F.col("app"), F.col("title")).alias("context_key"))


@query(f"WITH {TITLED_SQL} SELECT doc_id, coalesce(nullif(trim(t), ''), nullif(app, ''), 'unknown') AS context_label FROM t")
def context_label(spark, d):
    return _titled(spark, d).select("doc_id", tx.context_label(F.col("app"), F.col("title")).alias("context_label"))


_NOISE = "^(" + "|".join(tx.NAVIGATION_NOISE) + r")(\s|$)"


@query(f"""WITH t AS (SELECT doc_id, source AS app, lang, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Slack' WHEN 2 THEN source WHEN 3 THEN 'untitled' ELSE 'report' END AS title,
  CASE WHEN doc_id % 2 = 0 AND doc_id % 7 <> 0 THEN [{{'line': 'Save as', 'role': 'AXHeading'}}, {{'line': '[Nav] ' || lang || ' pane', 'role': 'AXToolbar'}}] ELSE [] END AS places,
  CASE WHEN doc_id % 7 = 0 THEN [] ELSE coalesce(list_transform(string_split(text, chr(10))[1:3], lambda x: '[Nav] ' || substr(x, 1, CAST(60 + doc_id % 3 * 20 AS INTEGER))), []) END AS nav FROM documents),
e AS (SELECT *, list_concat(places, list_transform(nav, lambda x: {{'line': x, 'role': 'AXStaticText'}})) AS every FROM t),
c AS (SELECT doc_id, i, trim(regexp_replace(every[i].line, '^\\[Nav\\]\\s*', '')) AS line, CASE every[i].role WHEN 'AXHeading' THEN 100 WHEN 'AXToolbar' THEN 65 ELSE 50 END AS score FROM e, unnest(range(1, len(every) + 1)) AS u(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM c WHERE line <> '' AND length(line) <= 80 AND NOT regexp_matches(lower(trim(line)), '{_NOISE}')),
b AS (SELECT doc_id, arg_max(line, score * 1000 - i) AS line FROM k WHERE r = 1 GROUP BY 1)
SELECT doc_id, CASE WHEN title = 'report' THEN title WHEN b.line IS NOT NULL THEN app || ' - ' || b.line WHEN lower(lang) <> lower(app) THEN lang ELSE title END AS title FROM t LEFT JOIN b USING (doc_id)""")
def enriched_title(spark, d):
    docs = table(spark, d, "documents")
    few = F.expr("doc_id % 7 = 0")
    place = lambda line, role: F.struct(F.lit(line).alias("line") if isinstance(line, str) else line.alias("line"), F.lit(role).alias("role"))
    places = F.when((F.col("doc_id") % 2 == 0) & ~few, F.array(place("Save as", "AXHeading"), place(F.concat(F.lit("[Nav] "), "lang", F.lit(" pane")), "AXToolbar"))).otherwise(F.array().cast("array<struct<line:string,role:string>>"))
    nav = F.when(~few, F.transform(F.slice(F.split("text", "\n", -1), 1, 3), lambda x: F.concat(F.lit("[Nav] "), F.substr(x, F.lit(1), (F.lit(60) + F.col("doc_id") % 3 * 20).cast("int")))))
    title = F.expr("CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Slack' WHEN 2 THEN source WHEN 3 THEN 'untitled' ELSE 'report' END")
    windows = F.array(F.lit("[Window] Untitled"), F.concat(F.lit("[Window] "), F.col("lang")))
    return docs.select("doc_id", tx.enriched_title(title, F.col("source"), nav, windows, places).alias("title"))


# --- privacy and ingestion --------------------------------------------------------------------------------------------


@query(f"WITH {RANGES_SQL} SELECT event_id AS frame_id FROM events WHERE lower(event_type) <> 'error' AND NOT EXISTS (SELECT 1 FROM ranges WHERE ts BETWEEN f AND t) AND ts < TIMESTAMP '2024-01-25'")
def privacy_filter(spark, d):
    kept = ig.without_excluded_apps(activity(spark, d), rows(spark, [("ERROR",)], "app string"))
    return ig.outside_pause(se.without_suppressed_points(kept, _ranges(spark)), True, "2024-01-25 00:00:00").select("frame_id")


@query("SELECT event_id AS frame_id FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-15 12:00:00', 100)")
def checkpoint_newer_than(spark, d):
    return ig.newer_than(activity(spark, d), "2024-01-15 12:00:00", 100).select("frame_id")


@query("""WITH r AS (SELECT ts, event_id, event_type = 'error' AND value > 49 AS failed FROM events), c AS (SELECT min({'t': ts, 'i': event_id}) FILTER (failed) AS c FROM r)
SELECT epoch_us(any_value(c.c).t) AS ceiling_us, any_value(c.c).i AS ceiling_id, epoch_us((max({'t': ts, 'i': event_id}) FILTER (NOT failed AND (c.c IS NULL OR {'t': ts, 'i': event_id} < c.c))).t) AS checkpoint_us,
  (max({'t': ts, 'i': event_id}) FILTER (NOT failed AND (c.c IS NULL OR {'t': ts, 'i': event_id} < c.c))).i AS checkpoint_id FROM r, c""")
def checkpoint_ceiling(spark, d):
    results = activity(spark, d).withColumn("failed", (F.col("app_name") == "error") & (F.col("value") > 49))
    return ig.checkpoint(results).select(us("ceiling_ts").alias("ceiling_us"), "ceiling_id", us("checkpoint_ts").alias("checkpoint_us"), "checkpoint_id")


@query("""WITH t AS (SELECT event_id AS id, CASE WHEN event_id % 11 > 0 THEN value END AS lag, event_id % 13 = 0 AS backlog FROM events)
SELECT id, CASE WHEN lag IS NULL THEN 'stale-beyond-window' WHEN backlog THEN 'catching-up' WHEN floor(lag) <= 15 THEN 'fresh' WHEN floor(lag) <= 30 THEN 'catching-up' ELSE 'stale-beyond-window' END AS state FROM t""")
def freshness_class(spark, d):
    return activity(spark, d).select(F.col("frame_id").alias("id"), ig.freshness(F.when(F.col("frame_id") % 11 > 0, F.col("value")), F.col("frame_id") % 13 == 0).alias("state"))


@query("""WITH a AS (SELECT 'a' || event_id AS id, CASE WHEN event_id % 9 <> 0 THEN event_id // 2 END AS frame_id, event_id AS seq FROM events WHERE event_id % 3 = 0),
o AS (SELECT 'o' || event_id AS id, CASE WHEN event_id % 9 <> 0 THEN event_id // 2 END AS frame_id, event_id AS seq FROM events WHERE event_id % 2 = 0),
b AS (SELECT *, 'accessibility' AS source, -seq AS o FROM a UNION ALL SELECT *, 'ocr', seq FROM o)
SELECT id, frame_id, source FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('frame:' || frame_id, 'id:' || id) ORDER BY source, o, id) AS r FROM b) WHERE r = 1""")
def source_merge(spark, d):
    e = activity(spark, d).select(F.when(F.col("frame_id") % 9 != 0, F.floor(F.col("frame_id") / 2)).alias("frame_id"), F.col("frame_id").alias("seq"))
    name = lambda p: e.withColumn("id", F.concat(F.lit(p), F.col("seq").cast("string")))
    return ig.merged_sources(name("a").filter("seq % 3 = 0"), name("o").filter("seq % 2 = 0")).select("id", "frame_id", "source")


@query("""WITH n AS (SELECT user_id AS frame_id, event_id AS id, CASE WHEN event_id % 5 > 0 THEN event_id - event_id % 5 END AS parent_id, event_type AS role FROM events),
m AS (SELECT n.*, p.role AS prole FROM n LEFT JOIN n p ON n.parent_id = p.id AND n.frame_id = p.frame_id)
SELECT frame_id, id FROM m WHERE role <> 'error' AND coalesce(prole, '') <> 'error'""")
def secure_subtree_rows(spark, d):
    nodes = activity(spark, d).select(F.col("user_id").alias("frame_id"), F.col("frame_id").alias("id"), F.when(F.col("frame_id") % 5 > 0, F.col("frame_id") - F.col("frame_id") % 5).alias("parent_id"), F.col("app_name").alias("role"))
    return lc.secure_subtrees(nodes, ["ERROR"]).select("frame_id", "id")


STATES_SQL = """s AS (SELECT event_id AS id, ts, event_id % 2 = 0 AS p, CASE WHEN event_id % 3 > 0 THEN ts - INTERVAL 1 HOUR * (event_id % 3 - 1) END AS a, ['Mail', event_type] AS apps FROM events)"""


def _states(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    started = F.expr("CASE WHEN event_id % 3 > 0 THEN ts - make_interval(0, 0, 0, 0, CAST(event_id % 3 - 1 AS INT)) END")
    return e.select(F.col("event_id").alias("id"), "ts", F.expr("event_id % 2 = 0").alias("paused"), started.alias("pause_started_at"), F.array(F.lit("Mail"), F.col("event_type")).alias("excluded_apps"), F.array().cast(pr.RANGES).alias("suppressed_ranges"))


@query(f"WITH {STATES_SQL} SELECT id, epoch_us(CASE WHEN p AND a IS NOT NULL THEN a ELSE ts END) AS since_us FROM s")
def privacy_pause(spark, d):
    return pr.paused(_states(spark, d), F.col("ts")).filter("paused").select("id", us("pause_started_at").alias("since_us"))


@query(f"WITH {STATES_SQL} SELECT id, epoch_us(a) AS from_us, epoch_us(greatest(a, ts - INTERVAL 1 MILLISECOND)) AS to_us FROM s WHERE p AND a IS NOT NULL")
def privacy_resume(spark, d):
    r = pr.resumed(_states(spark, d), F.col("ts")).filter("NOT paused").select("id", F.explode("suppressed_ranges").alias("r"))
    return r.select("id", us("r.from").alias("from_us"), us("r.to").alias("to_us"))


@query(f"""WITH {STATES_SQL} SELECT id, array_to_string(CASE WHEN id % 4 = 0 OR lower(apps[2]) = 'click' THEN apps ELSE list_append(apps, 'Click') END, ',') AS added, array_to_string(list_filter(apps, lambda x: lower(x) <> 'error'), ',') AS removed FROM s""")
def privacy_apps(spark, d):
    s = _states(spark, d)
    app = F.when(F.col("id") % 4 == 0, "  ").otherwise(" Click ")
    more = pr.excluded(s, app).select("id", F.array_join("excluded_apps", ",").alias("added"))
    return more.join(pr.included(s, F.lit("ERROR")).select("id", F.array_join("excluded_apps", ",").alias("removed")), "id")


@query("""WITH r AS (SELECT event_id AS id, ts, event_type AS c, event_id % 97 = 96 AS failed, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS t FROM events), m AS (SELECT min({'t': ts, 'i': id}) AS m FROM r WHERE failed),
b AS (SELECT c, min({'t': ts, 'i': id}) AS b FROM r WHERE failed AND t <> '' GROUP BY 1) SELECT r.id AS frame_id, NOT failed AND (m.m IS NULL OR {'t': ts, 'i': r.id} < m.m) AND (b.b IS NULL OR {'t': ts, 'i': r.id} < b.b) AS committed FROM r, m LEFT JOIN b ON r.c = b.c""")
def stream_commit(spark, d):
    r = activity(spark, d).withColumn("failed", F.col("frame_id") % 97 == 96).withColumn("extracted_text", F.when(F.col("frame_id") % 2 == 0, "x").otherwise(""))
    return ig.committed(r, "app_name").select("frame_id", "committed")


@query(f"""WITH {NUMBERED_SQL}, o AS (SELECT user_id, min(started_at) AS since FROM sessions WHERE NOT (ended_at < TIMESTAMP '2024-01-29 20:00:00' - INTERVAL 14400 SECOND) GROUP BY 1) SELECT frame_id FROM owned JOIN o USING (user_id) WHERE ts >= since AND ts <= TIMESTAMP '2024-01-29 22:00:00'""")
def stream_hydration(spark, d):
    still = ss.idle_flushed(sessions(spark, d), F.lit("2024-01-29 20:00:00").cast("timestamp"), IDLE).filter("is_open")
    return ig.hydrated(activity(spark, d), still, "2024-01-29 22:00:00", "user_id").select("frame_id")


# --- diagnostics ----------------------------------------------------------------------------------------------------

SAMPLE_SQL = f"{FRAMES_SQL}, sample AS (SELECT * FROM frames WHERE length(extracted_text) >= 24 ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 1000)"
TOP_SQL = "groups AS (SELECT extracted_text, app_name, window_name, count(*) AS occurrences, max(length(extracted_text)) AS text_chars FROM sample GROUP BY ALL HAVING count(*) > 1 ORDER BY occurrences DESC, text_chars DESC, app_name, window_name, extracted_text LIMIT 5)"


def _sample(spark, d):
    return dg.duplication_sample(frames(spark, d), "extracted_text")


def _wide_frames(spark, d):
    """Frames whose windows are languages: enough of them repeat."""
    return frames(spark, d).withColumn("window_name", F.lit("w")).withColumn("app_name", F.col("lang"))


@query(f"WITH {SAMPLE_SQL} SELECT count(*) AS total_rows, count(DISTINCT extracted_text) AS distinct_texts, CAST(coalesce(sum(length(extracted_text)), 0) AS BIGINT) AS total_chars FROM sample")
def dup_summary(spark, d):
    return dg.duplication_summary(_sample(spark, d), "extracted_text")


WIDE_SQL = SAMPLE_SQL.replace("d.source AS window_name", "'w' AS window_name").replace("e.event_type AS app_name", "d.lang AS app_name")


@query(f"WITH {WIDE_SQL}, {TOP_SQL} SELECT app_name, window_name, occurrences, CAST(text_chars AS INTEGER) AS text_chars, translate(substr(extracted_text, 1, 120), chr(10) || chr(13), '  ') AS preview FROM groups")
def dup_groups(spark, d):
    return dg.duplicate_groups(dg.duplication_sample(_wide_frames(spark, d), "extracted_text"), "extracted_text").select("app_name", "window_name", "occurrences", "text_chars", "preview")


@query(f"WITH {WIDE_SQL}, {TOP_SQL} SELECT CAST(coalesce(sum(occurrences), 0) AS BIGINT) AS duplicated_rows, CAST(coalesce(sum((occurrences - 1) * text_chars), 0) AS BIGINT) AS redundant_chars FROM groups")
def dup_redundancy(spark, d):
    return dg.redundancy(dg.duplicate_groups(dg.duplication_sample(_wide_frames(spark, d), "extracted_text"), "extracted_text"))


ELEMENTS_SQL = f"""{FRAMES_SQL}, elements AS (SELECT l_orderkey AS frame_id, l_linestatus AS role, CASE WHEN l_linenumber % 2 = 0 THEN 'ocr' ELSE 'accessibility' END AS source, l_returnflag AS text FROM lineitem),
rows AS (SELECT e.*, f.app_name, f.window_name, strlen(coalesce(e.text, '')) AS bytes FROM elements e JOIN frames f USING (frame_id))"""


def _elements(spark, d):
    source = F.when(F.col("l_linenumber") % 2 == 0, "ocr").otherwise("accessibility")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_linestatus").alias("role"), source.alias("source"), F.col("l_returnflag").alias("text")
    )


def _element_rows(spark, d):
    return dg.element_rows(_elements(spark, d), frames(spark, d))


@query(f"WITH {ELEMENTS_SQL} SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT app_name, window_name, source, role FROM rows)) AS distinct_keys, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM rows")
def element_dup_summary(spark, d):
    return dg.element_summary(_element_rows(spark, d))


@query(f"""WITH {ELEMENTS_SQL}, g AS (SELECT app_name, window_name, source, role, count(*) AS occurrences, CAST(sum(bytes) AS BIGINT) AS bytes, max(substr(text, 1, 120)) AS preview FROM rows GROUP BY ALL HAVING count(*) > 1)
SELECT *, CAST(floor(bytes * (occurrences - 1)::DOUBLE / occurrences + 0.5) AS BIGINT) AS redundant_bytes FROM g ORDER BY bytes DESC, occurrences DESC, app_name, window_name, source, role LIMIT 5""")
def element_dup_groups(spark, d):
    return dg.element_groups(_element_rows(spark, d))


@query(f"""WITH {FRAMES_SQL}, t AS (SELECT 'extracted_text' AS field, CAST(sum(strlen(extracted_text)) AS BIGINT) AS bytes FROM frames UNION ALL SELECT 'window_name', CAST(sum(strlen(window_name)) AS BIGINT) FROM frames UNION ALL SELECT 'app_name', CAST(sum(strlen(app_name)) AS BIGINT) FROM frames)
SELECT * FROM t WHERE bytes > 0 ORDER BY bytes DESC, field LIMIT 5""")
def hotspot_fields(spark, d):
    return dg.hotspot_fields(frames(spark, d), ["extracted_text", "window_name", "app_name"])


@query(f"""WITH {ELEMENTS_SQL} SELECT app_name, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT app_name, bytes FROM rows UNION ALL SELECT app_name, strlen(extracted_text) FROM frames) GROUP BY 1 ORDER BY bytes DESC, app_name LIMIT 5""")
def hotspot_apps(spark, d):
    return dg.hotspot_apps([_element_rows(spark, d), frames(spark, d).withColumn("bytes", F.octet_length("extracted_text"))])


@query(f"WITH {ELEMENTS_SQL} SELECT source, role, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS elements FROM rows WHERE source = 'accessibility' GROUP BY 1, 2 ORDER BY bytes DESC, role LIMIT 5")
def hotspot_roles(spark, d):
    return dg.hotspot_roles(_element_rows(spark, d))


@query(f"""WITH {WIDE_SQL}, n AS (SELECT * FROM frames WHERE strlen(extracted_text) > 0 ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 1000),
m AS (SELECT frame_id, app_name, window_name, CAST(strlen(extracted_text) AS INTEGER) AS bytes, CASE WHEN count(*) OVER (PARTITION BY extracted_text, app_name, window_name) > 1 THEN 'duplicate-heavy' ELSE 'unique-heavy' END AS kind FROM n)
SELECT * FROM m ORDER BY kind DESC, bytes DESC, frame_id DESC LIMIT 5""")
def heavy_growth_samples(spark, d):
    return dg.growth_samples(_wide_frames(spark, d), "extracted_text")


@query(f"""WITH {FRAMES_SQL} SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, frame_timestamp)) AS slice_us, app_name, window_name, CAST(sum(strlen(extracted_text)) AS BIGINT) AS bytes, count(*) AS frames FROM frames GROUP BY 1, 2, 3 ORDER BY bytes DESC, slice_us, app_name, window_name LIMIT 5""")
def heavy_growth_slices(spark, d):
    return dg.growth_slices(frames(spark, d), "extracted_text").select(us("slice_start").alias("slice_us"), "app_name", "window_name", "bytes", "frames")


@query(f"WITH {FRAMES_SQL}, n AS (SELECT strlen(extracted_text) AS b FROM frames ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 1000) SELECT count(*) AS frames, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes FROM n WHERE b > 0")
def heavy_growth_summary(spark, d):
    return dg.growth_summary(frames(spark, d), "extracted_text")


@query(f"WITH {FRAMES_SQL} SELECT lang AS value, count(*) AS matched_rows, CAST(sum(strlen(extracted_text)) AS BIGINT) AS bytes FROM frames GROUP BY 1 ORDER BY matched_rows DESC, value LIMIT 5")
def capture_reuse_signal(spark, d):
    return dg.reuse_signal(frames(spark, d), "lang", "extracted_text")


#: Each document's share of the bytes of a table, in the SQL of both engines.
OWNER = "CASE doc_id % 7 WHEN 0 THEN 'frames' WHEN 1 THEN 'frames_fts' WHEN 2 THEN 'frames_data' WHEN 3 THEN 'elements' WHEN 4 THEN 'elements_fts_idx' WHEN 5 THEN 'ui_fts' ELSE 'audio' END"
OWNED_SQL = f"t AS (SELECT {OWNER} AS name, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY 1)"


def _owned_bytes(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.expr(OWNER).alias("name")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))


@query(f"""WITH {OWNED_SQL}, b AS (SELECT *, CASE WHEN contains(name, '_fts') THEN 'fts' WHEN name = 'frames' OR name LIKE 'frames\\_%' ESCAPE '\\' THEN 'frames' WHEN name = 'elements' OR name LIKE 'elements\\_%' ESCAPE '\\' THEN 'elements' ELSE 'other' END AS bucket FROM t)
SELECT bucket, CAST(sum(bytes) AS BIGINT) AS bytes, string_agg(name, ',' ORDER BY name) AS tables FROM b GROUP BY 1 UNION ALL SELECT 'unattributed', CAST(greatest(1000000000000 - sum(bytes), 0) AS BIGINT), '' FROM t""")
def byte_attribution(spark, d):
    return dg.byte_attribution(_owned_bytes(spark, d), 1_000_000_000_000)


@query(f"WITH {OWNED_SQL} SELECT name AS key, bytes, round(bytes::DOUBLE / (SELECT sum(bytes) FROM t), 6) AS share FROM t ORDER BY bytes DESC, key")
def artifact_ranking(spark, d):
    return dg.artifact_ranking(_owned_bytes(spark, d).withColumnRenamed("name", "key"))


@query("""WITH t AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN ['accessibility', 'ocr'] WHEN event_type = 'error' THEN ['ocr'] ELSE [] END AS s FROM events), c AS (SELECT count(*) FILTER (list_contains(s, 'accessibility')) AS a, count(*) FILTER (NOT list_contains(s, 'accessibility') AND list_contains(s, 'ocr')) AS o FROM t)
SELECT a AS accessibility, o AS ocr, round(coalesce(a::DOUBLE / nullif(a + o, 0), 0), 6) AS accessibility_ratio FROM c""")
def ingestion_mix(spark, d):
    s = F.when(F.col("app_name").isin("click", "view"), F.array(F.lit("accessibility"), F.lit("ocr"))).when(F.col("app_name") == "error", F.array(F.lit("ocr"))).otherwise(F.array().cast("array<string>"))
    return dg.ingestion_mix(activity(spark, d).withColumn("source_types", s))


@query("""WITH t AS (SELECT CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS t FROM documents) SELECT count(*) AS total, count(*) FILTER (coalesce(t, '') = '') AS empty, round((count(*) FILTER (coalesce(t, '') = ''))::DOUBLE / count(*), 6) AS empty_ratio FROM t""")
def extraction_ratio(spark, d):
    return dg.extraction_ratio(table(spark, d, "documents").withColumn("extracted_text", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text"))))


STATE_SQL = "SELECT event_id AS id, event_id % 2 = 0 AS w, event_id % 3 = 0 AS r, event_id % 100 AS p, floor(value * 4) AS a FROM events"


@query(f"""WITH t AS ({STATE_SQL}) SELECT id, CASE WHEN NOT w AND NOT r THEN 'process-down' WHEN NOT w AND p > 60 THEN 'permissions-missing' WHEN NOT w THEN 'unknown' WHEN NOT r THEN 'process-down' WHEN a > 120 THEN 'idle' ELSE 'ok' END AS state FROM t""")
def capture_state(spark, d):
    i = F.col("frame_id")
    return activity(spark, d).select(i.alias("id"), dg.capture_state(i % 2 == 0, i % 3 == 0, i % 100, F.floor(F.col("value") * 4)).alias("state"))


@query("WITH t AS (SELECT event_id AS id, CAST(floor(value * 25) AS BIGINT) AS s FROM events) SELECT id, greatest(1000 - s, 0) AS headroom, s >= 900 AS warning FROM t")
def disk_budget(spark, d):
    x = dg.disk_budget(F.floor(F.col("value") * 25), F.lit(1000))
    return activity(spark, d).select(F.col("frame_id").alias("id"), x.alias("x")).select("id", F.col("x.headroom").cast("long").alias("headroom"), "x.warning")


@query(f"""WITH {FRAMES_SQL}, x AS (SELECT 'extracted_text' AS field, extracted_text AS v, frame_timestamp, frame_id FROM frames UNION ALL SELECT 'window_name', window_name, frame_timestamp, frame_id FROM frames),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY frame_timestamp DESC, frame_id DESC) AS r FROM x WHERE length(v) >= 4 AND frame_timestamp >= TIMESTAMP '2024-01-01 02:00:00')
SELECT f.field, count(v) AS total_rows, count(DISTINCT v) AS distinct_texts, CAST(coalesce(sum(length(v)), 0) AS BIGINT) AS total_chars FROM (VALUES ('extracted_text', 400), ('window_name', 50)) f(field, n) LEFT JOIN r ON r.field = f.field AND r.r <= f.n GROUP BY 1""")
def dup_summary_fields(spark, d):
    return dg.duplication_by_field(frames(spark, d), {"extracted_text": 400, "window_name": 50}, "2024-01-01 02:00:00", min_text=4)


@query("SELECT event_id AS frame_id FROM events WHERE coalesce(CASE WHEN event_id % 3 = 0 THEN event_id * 2 END, event_id) IN (SELECT l_orderkey FROM lineitem)")
def frames_with_elements(spark, d):
    f = activity(spark, d).withColumn("elements_ref_frame_id", F.when(F.col("frame_id") % 3 == 0, F.col("frame_id") * 2))
    return dg.with_elements(f, _elements(spark, d)).select("frame_id")


NODES_SQL = "n AS (SELECT user_id AS frame_id, event_id AS id, CASE WHEN event_id % 5 > 0 THEN event_id - event_id % 5 END AS parent_id, event_type AS role FROM events)"


def _nodes(spark, d) -> DataFrame:
    i = F.col("frame_id")
    return activity(spark, d).select(F.col("user_id").alias("frame_id"), i.alias("id"), F.when(i % 5 > 0, i - i % 5).alias("parent_id"), F.col("app_name").alias("role"), F.col("app_name").alias("text"))


@query(f"WITH {NODES_SQL} SELECT n.frame_id, n.id, p.role AS parent_role FROM n LEFT JOIN n p ON n.parent_id = p.id AND n.frame_id = p.frame_id")
def element_parents(spark, d):
    return dg.with_parents(_nodes(spark, d)).select("frame_id", "id", "parent_role")


# three trees of paths, two of rows without any, by frame
@query("""WITH p AS (SELECT l_orderkey AS frame_id, l_linenumber AS n, CASE WHEN l_orderkey % 3 > 0 THEN CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '0.1' WHEN 3 THEN '0.1.0' WHEN 4 THEN '0.10' ELSE '0.2.' || l_linenumber END END AS path, l_returnflag AS role FROM lineitem),
hit AS (SELECT DISTINCT p.frame_id, p.n FROM p JOIN p s ON s.frame_id = p.frame_id AND s.role = 'R' AND s.path IS NOT NULL AND (p.path = s.path OR starts_with(p.path, s.path || '.'))),
gone AS (SELECT * FROM hit UNION SELECT frame_id, n FROM p WHERE role = 'R' AND path IS NOT NULL)
SELECT p.frame_id, p.n AS id FROM p LEFT JOIN gone g ON g.frame_id = p.frame_id AND g.n = p.n WHERE p.role <> 'R' AND g.n IS NULL""")
def secure_paths(spark, d):
    path = F.expr("CASE WHEN l_orderkey % 3 > 0 THEN CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '0.1' WHEN 3 THEN '0.1.0' WHEN 4 THEN '0.10' ELSE '0.2.' || l_linenumber END END")
    nodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("role"), path.alias("path"))
    return lc.secure_subtrees(nodes, ["r"]).select("frame_id", "id")


@query("""SELECT event_id AS frame_id, array_to_string(CASE WHEN event_id % 3 = 0 THEN ['ocr'] WHEN event_id % 2 = 0 THEN ['accessibility', 'ui'] ELSE [] END, ',') AS sources FROM events""")
def source_precedence(spark, d):
    metadata = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"sourceTypes":["ocr"]}' WHEN 1 THEN '{"other":1}' END""")
    own = F.expr("CASE WHEN event_id % 2 = 0 THEN array('accessibility', 'ui') END")
    return table(spark, d, "events").select(F.col("event_id").alias("frame_id"), F.array_join(ig.source_types(metadata, own), ",").alias("sources"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 1 THEN 1 ELSE len(embedding) END AS n FROM embeddings")
def upsert_vectors(spark, d):
    have = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    new = have.filter("vec_id % 3 = 0").select("vec_id", F.when(F.col("vec_id") % 4 == 0, F.array().cast("array<double>")).when(F.col("vec_id") % 2 == 1, F.array(F.lit(0.5))).alias("embedding"))
    return ig.upserted(have, ig.with_embedding(new), "vec_id", "vec_id").select("vec_id", F.size("embedding").cast("long").alias("n"))


# --- lifecycle --------------------------------------------------------------------------------------------------------


def _ids(spark, d, condition: str):
    return activity(spark, d).filter(condition).select("frame_id")


@query(f"WITH {NUMBERED_SQL} SELECT session_id FROM sessions WHERE session_id NOT IN (SELECT session_id FROM owned WHERE frame_id % 50 = 0)")
def delete_cascade_sessions(spark, d):
    return lc.sessions_without_frames(sessions(spark, d), _ids(spark, d, "frame_id % 50 = 0")).select("session_id")


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'extracted:' || vec_id ELSE 'cap' || vec_id END AS id, CASE WHEN vec_id % 3 = 1 THEN vec_id END AS m, 'screen:frame:' || vec_id AS c FROM embeddings), x AS (SELECT event_id AS f FROM events WHERE event_id % 4 = 0)
SELECT id FROM v WHERE NOT (CASE WHEN id LIKE 'extracted:%' THEN vec_id IN (SELECT f FROM x) ELSE coalesce(m IN (SELECT f FROM x), false) OR CAST(regexp_extract(c, ':frame:(-?[0-9]+)$', 1) AS BIGINT) IN (SELECT f FROM x) END)""")
def delete_vectors_three_rules(spark, d):
    v = table(spark, d, "embeddings").select(
        F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("extracted:"), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("cap"), F.col("vec_id").cast("string"))).alias("id"),
        F.when(F.col("vec_id") % 3 == 1, F.col("vec_id")).alias("meta_frame_id"),
        tx.capture_id(F.lit("screen"), F.col("vec_id"), F.lit("")).alias("capture_id"),
    )
    return lc.vectors_without_frames(v, _ids(spark, d, "frame_id % 4 = 0")).select("id")


@query("SELECT event_id AS frame_id FROM events WHERE NOT date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10 10:00:00' AND TIMESTAMP '2024-01-12 10:00:00'")
def delete_range(spark, d):
    a = activity(spark, d)
    return lc.content_without_frames(a, lc.frames_in_range(a, "2024-01-10 10:00:00", "2024-01-12 10:00:00")).select("frame_id")


@query("""WITH t AS (SELECT event_id, ts, CAST(floor(value * 100) AS BIGINT) AS bytes, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
s AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bytes) OVER () AS total FROM t),
b AS (SELECT i // 100 AS b, min(before) AS freed, any_value(total) AS total FROM s GROUP BY 1)
SELECT event_id AS frame_id FROM s JOIN b ON s.i // 100 = b.b WHERE b.total - freed > b.total // 2 AND ts < TIMESTAMP '2024-01-20'""")
def retention_cut(spark, d):
    sized = activity(spark, d).withColumn("bytes", F.floor(F.col("value") * 100))
    return lc.retention_cut(sized, F.floor(F.col("total") / 2), "2024-01-20 00:00:00")


@query("SELECT e.event_id AS frame_id, e.event_id * 2 AS elements_ref_frame_id FROM events e WHERE event_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = e.event_id * 2)")
def dangling_refs(spark, d):
    f = activity(spark, d).withColumn("elements_ref_frame_id", F.when(F.col("frame_id") % 3 == 0, F.col("frame_id") * 2))
    return dg.dangling_references(f, _elements(spark, d)).select("frame_id", "elements_ref_frame_id")


@query("""WITH c AS (SELECT doc_id, text FROM documents), n AS (SELECT doc_id, lang AS text FROM documents WHERE doc_id % 3 = 0) SELECT * FROM n UNION ALL SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM n)""")
def upsert_content(spark, d):
    docs = table(spark, d, "documents")
    new = docs.filter("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("text"))
    return ig.upserted(docs.select("doc_id", "text"), new, "doc_id", "text")


@query("""WITH h AS (SELECT sha256(text) AS hash, lang FROM documents WHERE doc_id % 2 = 0), c AS (SELECT hash, min(lang) AS lang FROM h GROUP BY 1), n AS (SELECT sha256(text) AS hash, min(lang) AS lang FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT * FROM c UNION ALL SELECT * FROM n WHERE hash NOT IN (SELECT hash FROM c)""")
def insert_if_absent(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("hash"), "lang")
    have = docs.filter("doc_id % 2 = 0").groupBy("hash").agg(F.min("lang").alias("lang"))
    return ig.inserted_if_absent(have, docs.filter("doc_id % 2 = 1").select("hash", "lang"), "hash")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents")
def sparse_update(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return ig.updated(docs, docs.filter("doc_id % 5 = 0").select("doc_id", F.lit("xx").alias("lang")), "doc_id")


@query("""SELECT event_id AS frame_id, CASE WHEN ts < TIMESTAMP '2024-01-15' AND coalesce(CASE WHEN event_id % 3 = 0 THEN event_id * 2 END, event_id) IN (SELECT l_orderkey FROM lineitem) THEN NULL ELSE '{}' END AS tree FROM events""")
def sweep_trees(spark, d):
    f = activity(spark, d).withColumn("elements_ref_frame_id", F.when(F.col("frame_id") % 3 == 0, F.col("frame_id") * 2)).withColumn("accessibility_tree_json", F.lit("{}"))
    return lc.without_trees(f, _elements(spark, d), "2024-01-15 00:00:00").select("frame_id", F.col("accessibility_tree_json").alias("tree"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'no time' ELSE strftime(date_trunc('second', ts) - INTERVAL 2 HOUR * CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END, '%Y-%m-%dT%H:%M:%S.000Z') END AS t FROM events""")
def migrate_times(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "no time").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.000"), F.when(F.col("event_id") % 3 == 1, "+02:00").otherwise("Z")))
    return lc.migrated(table(spark, d, "events").select("event_id", text.alias("t")), ["t"])


@query("""SELECT vec_id FROM embeddings JOIN events ON vec_id = event_id WHERE NOT date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 12:00:00'""")
def delete_cascade_range(spark, d):
    v = vectors(spark, d).select("vec_id", "id", F.lit(None).cast("long").alias("meta_frame_id"), F.lit("").alias("capture_id"), F.lit("").alias("frame_timestamp"), F.date_trunc("second", "frame_timestamp").alias("timestamp"))
    left = lc.cascade_range(sessions(spark, d), activity(spark, d), v, activity(spark, d), "2024-01-01 01:00:00", "2024-01-01 12:00:00")
    return left[2].select("vec_id")


@query(f"""WITH {NUMBERED_SQL}, s AS (SELECT NOT (ended_at < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 14400 SECOND) AS is_open, CASE frames % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'degraded' END AS st FROM sessions)
SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS empty, count(*) AS sessions, count(*) FILTER (is_open) AS open, count(*) FILTER (st IN ('failed', 'degraded')) AS failed FROM s""")
def status_roll_up(spark, d):
    s = ss.idle_flushed(sessions(spark, d), F.lit("2024-01-30 20:00:00").cast("timestamp"), IDLE)
    s = s.withColumn("summary_status", F.expr("CASE frames % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'degraded' END"))
    return dg.roll_up(table(spark, d, "documents").withColumnRenamed("text", "extracted_text"), s).select("total", "empty", "sessions", "open", "failed")


@query(f"""WITH {FRAMES_SQL}, {NUMBERED_SQL}, s AS (SELECT NOT (ended_at < TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 14400 SECOND) AS is_open, CASE frames % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'degraded' END AS st FROM sessions),
t AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN ['accessibility', 'ocr'] WHEN event_type = 'error' THEN ['ocr'] ELSE [] END AS s FROM events), m AS (SELECT count(*) FILTER (list_contains(s, 'accessibility')) AS a, count(*) FILTER (NOT list_contains(s, 'accessibility') AND list_contains(s, 'ocr')) AS o FROM t),
f AS (SELECT count(*) AS total, count(*) FILTER (coalesce(extracted_text, '') = '') AS empty, max(frame_timestamp) AS last, CAST(coalesce(sum(strlen(extracted_text)), 0) AS BIGINT) AS bytes FROM frames)
SELECT CASE WHEN epoch(TIMESTAMP '2024-02-01') - epoch(last) > 120 THEN 'idle' ELSE 'ok' END AS capture, a AS accessibility, o AS ocr, round(coalesce(a::DOUBLE / nullif(a + o, 0), 0), 6) AS accessibility_ratio, greatest(5000000 - bytes, 0) AS headroom, bytes >= 4500000 AS disk_warning, true AS checkpoint_exists, 'needs-rebuild' AS recovery,
  total, empty, round(empty::DOUBLE / total, 6) AS empty_ratio, (SELECT count(*) FROM s) AS sessions, (SELECT count(*) FILTER (is_open) FROM s) AS open, (SELECT count(*) FILTER (st = 'ready') FROM s) AS ready, (SELECT count(*) FILTER (st = 'pending') FROM s) AS pending, (SELECT count(*) FILTER (st IN ('failed', 'degraded')) FROM s) AS failed FROM m, f""")
def internal_status(spark, d):
    s = ss.idle_flushed(sessions(spark, d), F.lit("2024-01-30 20:00:00").cast("timestamp"), IDLE)
    s = s.withColumn("summary_status", F.expr("CASE frames % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'degraded' END"))
    sources = F.when(F.col("app_name").isin("click", "view"), F.array(F.lit("accessibility"), F.lit("ocr"))).when(F.col("app_name") == "error", F.array(F.lit("ocr"))).otherwise(F.array().cast("array<string>"))
    facts = rows(spark, [("2024-02-01 00:00:00", True, 100, True, "2024-01-30 00:00:00", True)], "now string, running boolean, process_age int, persisted boolean, checkpoint string, backlog boolean").withColumn("now", F.col("now").cast("timestamp"))
    sized = frames(spark, d).withColumn("bytes", F.octet_length("extracted_text"))
    return dg.internal_status(sized, s, activity(spark, d).withColumn("source_types", sources), facts, 5_000_000)


@query("""SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN doc_id % 3 > 0 THEN ',"lang":"' || lang || '"' ELSE '' END || '}' AS shown FROM documents""")
def elided_fields(spark, d):
    return table(spark, d, "documents").withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).select("doc_id", dg.elided(["doc_id", "lang"]).alias("shown"))


# --- text, routines, evaluation -----------------------------------------------------------------------------------------

_S = "t"
for _p, _m in tx.SECRETS:
    _S = f"regexp_replace({_S}, '{_p}', '{_m}', 'g')"


@query(f"WITH x AS (SELECT doc_id, text || ' Bearer abc.def-123== key sk-abcdefghijklmnopqrstuv' || doc_id || ' xoxb-12-' || doc_id AS t FROM documents) SELECT doc_id, {_S} AS t FROM x")
def redact_secrets(spark, d):
    t = F.expr("text || ' Bearer abc.def-123== key sk-abcdefghijklmnopqrstuv' || doc_id || ' xoxb-12-' || doc_id")
    return table(spark, d, "documents").select("doc_id", tx.redact_secrets(t).alias("t"))


LINES_SQL = """files AS (SELECT doc_id AS key, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT key, i AS line_number, s[i] AS line FROM files, unnest(range(1, len(s) + 1)) AS u(i) WHERE NOT (i = len(s) AND s[i] = ''))"""


@query(f"""WITH {LINES_SQL}, t AS (SELECT key, line_number, len(list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(line, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9_]+')), lambda x: length(x) >= 3 AND x IN ('the', 'and', 'that', 'thereat', 'with', 'from'))) AS score FROM l)
SELECT key, line_number, CAST(score AS INTEGER) AS score FROM t WHERE score > 0 ORDER BY score DESC, key, line_number LIMIT 5""")
def token_overlap_topn(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    found = rt.evidence_lines(rt.file_lines(docs), "the and that thereat with from", 5, ascii_only=True)
    return found.select("key", F.col("line_number").cast("long").alias("line_number"), "score")


#: Whole texts with a line of other scripts in front, as many kinds as there are ids.
SCRIPTS = ["用户界面設計2024", "テスト ひらがな abc漢字XyZ", "한국어 문장이다 foo한bar", "Ünï cafe\u0301 né ab", "camelCaseWord snake_case x1"]
_TOKEN_SQL = """lower(regexp_replace(['{}'][doc_id % 5 + 1] || ' ' || coalesce(text, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))""".format("', '".join(SCRIPTS))
_CJK_SQL = "[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]"


@query(f"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({_TOKEN_SQL}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))) AS w FROM documents), r AS (SELECT doc_id, w, regexp_extract_all(w, '{_CJK_SQL}+') AS runs FROM w),
t AS (SELECT doc_id, w AS t FROM r WHERE len(runs) > 0 OR length(regexp_replace(w, '\\p{{M}}', '', 'g')) >= 3 UNION SELECT doc_id, unnest(list_filter(regexp_extract_all(w, '[a-z0-9_]+'), lambda x: length(x) >= 3)) FROM r WHERE len(runs) > 0
  UNION SELECT doc_id, unnest(runs) FROM r UNION SELECT doc_id, substring(run, i, n) FROM (SELECT doc_id, unnest(runs) AS run FROM r), unnest(range(1, 5)) AS a(n), unnest(range(1, length(run) - n + 2)) AS b(i) WHERE n >= CASE WHEN regexp_matches(run, '\\p{{Han}}') THEN 1 ELSE 2 END)
SELECT doc_id, count(*) AS n, sha256(string_agg(t, ' ' ORDER BY t)) AS tokens FROM t GROUP BY 1""")
def tokens_of_scripts(spark, d):
    docs = table(spark, d, "documents")
    line = F.concat(F.array(*[F.lit(x) for x in SCRIPTS])[(F.col("doc_id") % 5).cast("int")], F.lit(" "), F.coalesce("text", F.lit("")))
    own = docs.select("doc_id", tx.tokens(line).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join(F.sort_array("t"), " ").cast("binary"), 256).alias("tokens"))


@query(f"WITH {LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY line_number) AS r FROM l WHERE trim(line) <> '') SELECT key, string_agg(trim(line), chr(10) ORDER BY line_number) AS highlights FROM n WHERE r <= 3 GROUP BY 1")
def file_highlights(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return rt.highlights(docs).select("key", F.array_join("highlights", "\n").alias("highlights"))


@query("""WITH defs AS (SELECT DISTINCT event_type AS name FROM events WHERE event_type <> 'view' UNION ALL SELECT 'never'), runs AS (SELECT event_type AS name, event_id AS run_id, CASE WHEN value > 25 THEN 'ok' ELSE 'failed' END AS status, ts FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, run_id DESC) AS r FROM runs) SELECT d.name, r.run_id AS last_run_id, r.status AS last_status FROM defs d LEFT JOIN r ON d.name = r.name AND r.r = 1""")
def routine_latest_run(spark, d):
    a = activity(spark, d)
    defs = a.select(F.col("app_name").alias("name")).filter("name <> 'view'").distinct().unionByName(rows(spark, [("never",)], "name string"))
    runs = a.select(F.col("app_name").alias("name"), F.col("frame_id").alias("run_id"), F.when(F.col("value") > 25, "ok").otherwise("failed").alias("status"), F.col("frame_timestamp").alias("started_at"))
    return rt.latest_runs(defs, runs).select("name", "last_run_id", "last_status")


CRON = "CASE event_id % 6 WHEN 0 THEN '0 9 * * 1' WHEN 1 THEN '0 9 1 * *' WHEN 2 THEN event_id % 60 || ' 9 * * *' WHEN 3 THEN '*/5 * * * *' WHEN 4 THEN '0 0 9 * * *' ELSE 'bad' END"


@query(f"""WITH t AS (SELECT event_id AS id, string_split({CRON}, ' ') AS f FROM events), g AS (SELECT id, CASE WHEN len(f) = 6 THEN f[2:6] ELSE f END AS f FROM t)
SELECT id, CASE WHEN len(f) < 5 THEN 60 WHEN f[5] <> '*' THEN 10080 WHEN f[3] <> '*' THEN 43200 WHEN f[2] <> '*' THEN 1440 ELSE 60 END AS minutes FROM g""")
def cron_lookback(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), vl.cron_lookback_minutes(F.expr(CRON)).alias("minutes"))


@query(f"""WITH {FRAMES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY extracted_text ORDER BY frame_timestamp DESC, frame_id DESC) AS r FROM frames WHERE app_name = 'view')
SELECT frame_id, app_name, CASE WHEN length(extracted_text) > 120 THEN substr(extracted_text, 1, 120) || '[truncated]' ELSE extracted_text END AS extracted_text FROM f WHERE r = 1 ORDER BY frame_timestamp DESC, frame_id DESC LIMIT 10""")
def activity_overview(spark, d):
    return rt.briefing_evidence(frames(spark, d).filter("app_name = 'view'")).select("frame_id", "app_name", "extracted_text")


@query("""SELECT source AS module, lang AS language, CAST(GROUPING(source) * 2 + GROUPING(lang) AS BIGINT) AS grouping, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source), (lang), ())""")
def source_stats_grouping_sets(spark, d):
    r = table(spark, d, "documents").select(F.col("source").alias("module"), F.col("lang").alias("language"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"))
    return rt.source_stats(r, ["module", "language"], ["lines", "chars"])


#: A made source file for each document: statements with comments, a block comment with a blank line, hash lines, a template literal with one.
FILE = "repeat('x = 1; // c\n', doc_id % 5) || '/* a\n\nb */\n' || repeat('# no\n', doc_id % 3) || '`t\n\n u`;\n'"
KINDS_SQL = """k AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 2 = 1 THEN 'sh' ELSE 'ts' END AS dir, doc_id % 5 + doc_id % 3 + 6 AS total,
  CASE WHEN doc_id % 2 = 1 THEN doc_id % 5 + 4 ELSE doc_id % 5 + doc_id % 3 + 2 END AS code, CASE WHEN doc_id % 2 = 1 THEN doc_id % 3 ELSE 3 END AS comment, CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 1 END AS blank FROM documents)"""


def _kinds(spark, d) -> DataFrame:
    odd = F.col("doc_id") % 2 == 1
    kinds = cd.line_kinds(F.expr(FILE), F.when(odd, ".sh").otherwise(".ts"))
    files = table(spark, d, "documents").select(F.col("source").alias("module"), F.col("lang").alias("language"), F.when(odd, "sh").otherwise("ts").alias("directory"), F.col("doc_id").alias("path"), kinds.alias("k"))
    return files.select("module", "language", "directory", "path", "k.*")


# files of a comment or a template that is never closed, with line ends of both kinds, or without an end
@query("""SELECT doc_id AS path, doc_id % 4 + 2 + doc_id % 5 + 1 AS total, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 ELSE doc_id % 4 + 2 + CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 ELSE 0 END END AS code, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 + 3 ELSE 0 END AS comment,
  CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS blank FROM documents""")
def source_kinds_unclosed(spark, d):
    even = F.expr("repeat('x = 1;\r\n', doc_id % 4) || '/* a\n\n' || repeat('b\r\n', doc_id % 5) || 'c' || if(doc_id % 3 = 0, '\n', '')")
    odd = F.expr("repeat('x = 1;\n', doc_id % 4) || '`a\n\n' || repeat('b\n', doc_id % 5) || 'c' || if(doc_id % 3 = 0, '\n', '')")
    k = cd.line_kinds(F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd), F.lit(".ts"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("path"), k.alias("k")).select("path", "k.total", "k.code", "k.comment", "k.blank")


@query(f"""WITH {KINDS_SQL} SELECT source AS module, lang AS language, dir AS directory, CAST(GROUPING(source) * 4 + GROUPING(lang) * 2 + GROUPING(dir) AS BIGINT) AS grouping, count(*) AS files,
  CAST(sum(total) AS BIGINT) AS total, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank FROM k GROUP BY GROUPING SETS ((source), (lang), (dir), ())""")
def source_line_kinds(spark, d):
    return rt.source_stats(_kinds(spark, d), ["module", "language", "directory"], ["total", "code", "comment", "blank"])


@query(f"WITH {KINDS_SQL} SELECT doc_id AS path, code FROM k ORDER BY code DESC, doc_id LIMIT 10")
def largest_sources(spark, d):
    return rt.largest_sources(_kinds(spark, d)).select("path", "code")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'FILE_NOT_FOUND' WHEN doc_id % 13 = 0 THEN 'PATH_IS_DIRECTORY' WHEN doc_id % 7 = 0 THEN 'PATH_NOT_ALLOWED' WHEN length(text) > 4000 THEN 'FILE_TOO_LARGE' WHEN doc_id % 5 = 0 THEN 'UNSUPPORTED_EXTENSION' WHEN text IS NULL THEN 'FILE_READ_FAILED'
  WHEN doc_id % 3 = 0 THEN 'BINARY_CONTENT' END AS error FROM documents""")
def file_validation(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 7 == 0, "/databank/").otherwise("/data/"), i.cast("string"), F.when(i % 5 == 0, ".exe").otherwise(".TXT"))
    content = F.when(i % 3 == 0, F.encode(F.concat("text", F.lit("a\0b")), "utf-8")).otherwise(F.encode("text", "utf-8"))
    files = table(spark, d, "documents").select("doc_id", path.alias("path"), F.when(i % 11 == 0, None).when(i % 13 == 0, "directory").otherwise("file").alias("kind"), F.length("text").alias("length"), content.alias("content"))
    return rt.file_error(files, ["/data/"], most=4000).select("doc_id", "error")


@query("""WITH p AS (SELECT DISTINCT event_id FROM events WHERE event_id % 2 = 0), t AS (SELECT DISTINCT event_id FROM events WHERE event_id % 3 = 0), b AS (SELECT count(*) FILTER (p.event_id IS NOT NULL AND t.event_id IS NOT NULL) AS hit, count(p.event_id) AS predicted, count(t.event_id) AS truth FROM p FULL JOIN t ON p.event_id = t.event_id)
SELECT hit, predicted, truth, round(hit::DOUBLE / predicted, 6) AS precision, round(hit::DOUBLE / truth, 6) AS recall FROM b""")
def eval_precision_recall(spark, d):
    a = activity(spark, d)
    return rt.precision_recall(a.filter("frame_id % 2 = 0"), a.filter("frame_id % 3 = 0"), ["frame_id"])


@query(f"""WITH {NUMBERED_SQL}, p AS (SELECT frame_id, CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS p FROM owned), b AS (SELECT o.session_id, p.p, count(*) AS both_ FROM owned o JOIN p USING (frame_id) GROUP BY 1, 2),
np AS (SELECT p, count(*) AS n FROM p GROUP BY 1), nt AS (SELECT session_id, count(*) AS n FROM owned GROUP BY 1)
SELECT session_id, round(max(both_::DOUBLE / (np.n + nt.n - both_)), 6) AS iou FROM b JOIN np USING (p) JOIN nt USING (session_id) GROUP BY 1""")
def session_iou(spark, d):
    n = numbered(spark, d)
    daily = n.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("frame_timestamp").cast("string")).alias("session_id"), "frame_id")
    return rt.session_iou(daily, n.select("session_id", "frame_id"))


@query("SELECT event_type AS app_name, list_sort(list(value))[greatest(CAST(floor(count(*) * 0.95) AS BIGINT) - 1, 0) + 1] AS p95, count(*) AS n FROM events GROUP BY 1")
def p95_index(spark, d):
    return rt.p95_by_index(activity(spark, d), "app_name", "value", "p95")


# --- scans and small functions ----------------------------------------------------------------------------------------


@query("SELECT event_id AS frame_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 600 MINUTE AND TIMESTAMP '2024-01-20'")
def recent_window(spark, d):
    return rd.recent(activity(spark, d), 600, "2024-01-20 00:00:00").select("frame_id")


@query("SELECT event_id AS frame_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-09 12:00:00'")
def derived_window(spark, d):
    return rd.between(activity(spark, d), "2024-01-08 00:00:00", "2024-01-09 12:00:00").select("frame_id")


@query("SELECT vec_id, event_type AS app_name FROM embeddings JOIN events ON vec_id = event_id WHERE ts BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 12:00:00'")
def vector_window(spark, d):
    return rd.between(vectors(spark, d), "2024-01-01 01:00:00", "2024-01-01 12:00:00").select("vec_id", "app_name")


@query("SELECT event_id AS frame_id FROM events WHERE event_id IN (SELECT l_orderkey FROM lineitem)")
def multi_key_lookup(spark, d):
    return rd.by_ids(activity(spark, d), _elements(spark, d)).select("frame_id")


RAW = [
    "doc_id AS frame_id", "doc_id % 50 AS seq", "CASE WHEN doc_id % 5 > 0 THEN 'r' || doc_id END AS id", "CASE WHEN doc_id % 7 > 0 THEN '2024-01-01T00:00:00Z' END AS timestamp",
    "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE lang END AS text", """CASE doc_id % 4 WHEN 0 THEN '{"role": "AXGroup"}' WHEN 1 THEN '[]' WHEN 2 THEN 'role' END AS accessibility_tree_json""",
]


@query(f"""WITH r AS (SELECT {', '.join(RAW)} FROM documents) SELECT frame_id, coalesce(id, 'frame:' || frame_id || ':' || (seq + 100)) AS id FROM r WHERE timestamp IS NOT NULL AND (trim(coalesce(text, '')) <> '' OR accessibility_tree_json LIKE '{{%')""")
def normalised_records(spark, d):
    raw = table(spark, d, "documents").selectExpr(*RAW).withColumn("accessibility_tree_json", F.replace("accessibility_tree_json", F.lit(": "), F.lit(":\n ")))
    return ig.normalised_records(raw, 100).select("frame_id", "id")


@query("SELECT vec_id FROM embeddings JOIN events ON vec_id = event_id WHERE NOT CASE WHEN vec_id % 3 = 2 THEN date_trunc('second', ts) ELSE ts END BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 12:00:00'")
def vectors_outside_range(spark, d):
    v = vectors(spark, d).withColumnRenamed("frame_timestamp", "timestamp")
    text = F.when(F.col("vec_id") % 3 == 0, "").when(F.col("vec_id") % 3 == 1, "no time").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    return lc.vectors_outside(v.withColumn("frame_timestamp", text), "2024-01-01 01:00:00", "2024-01-01 12:00:00").select("vec_id")


@query("SELECT event_id AS run_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 25")
def routine_history(spark, d):
    runs = activity(spark, d).select(F.col("app_name").alias("name"), F.col("frame_id").alias("run_id"), F.col("frame_timestamp").alias("started_at"))
    return rt.history(runs, "click", 25).select("run_id")


@query("""WITH f AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 2 END AS ref, CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN '' END AS t FROM events)
SELECT count(*) AS frames, count(*) FILTER (coalesce(t, '') <> '') AS with_tree, (SELECT count(*) FROM lineitem) AS elements, count(*) FILTER (ref IS NOT NULL AND ref NOT IN (SELECT l_orderkey FROM lineitem)) AS dangling FROM f""")
def maintenance_counts(spark, d):
    i = F.col("frame_id")
    f = activity(spark, d).withColumn("elements_ref_frame_id", F.when(i % 3 == 0, i * 2)).withColumn("accessibility_tree_json", F.when(i % 4 == 0, "{}").when(i % 4 == 1, ""))
    return dg.maintenance_counts(f, _elements(spark, d)).select("frames", "with_tree", "elements", "dangling")


@query("SELECT doc_id, regexp_replace(regexp_replace(lower('-- ' || source || ' & ' || upper(lang) || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS name FROM documents")
def routine_names(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.routine_name(F.concat(F.lit("-- "), "source", F.lit(" & "), F.upper("lang"), F.lit("!"))).alias("name"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN chr(10) ELSE '' END AS t FROM documents), s AS (SELECT doc_id, string_split(t, chr(10)) AS s FROM t)
SELECT doc_id, CASE WHEN s[len(s)] = '' THEN len(s) - 1 ELSE len(s) END AS n FROM s""")
def line_counts(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, "\n").otherwise(""))
    crlf = F.when(F.col("doc_id") % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return table(spark, d, "documents").select("doc_id", F.size(tx.lines(crlf)).cast("long").alias("n"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || ',' || source WHEN 1 THEN lang ELSE '' END AS parts FROM documents""")
def json_arrays(spark, d):
    text = F.when(F.col("doc_id") % 4 == 0, F.to_json(F.array("lang", "source"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('["'), "lang", F.lit('", null]'))).when(F.col("doc_id") % 4 == 2, "[1, ")
    return table(spark, d, "documents").select("doc_id", F.array_join(vl.string_array(text), ",").alias("parts"))


@query("""SELECT event_id, epoch_us(CASE event_id % 3 WHEN 0 THEN ts - INTERVAL 1 HOUR WHEN 1 THEN ts - INTERVAL 1 DAY ELSE TIMESTAMP '0001-01-01' END) AS start_us,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN epoch_us(date_trunc('second', ts)) ELSE epoch_us(date_trunc('second', ts)) - 7200000000 END AS utc_us FROM events""")
def time_functions(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    word = F.expr("CASE event_id % 3 WHEN 0 THEN 'last_1h' WHEN 1 THEN 'last_1d' ELSE 'all' END")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.expr("CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+02:00' END"))
    return e.select("event_id", us(vl.privacy_range_start(word, F.col("ts"))).alias("start_us"), us(vl.utc_timestamp(text)).alias("utc_us"))


@query(f"WITH {FRAMES_SQL}, g AS (SELECT lang, count(*) AS n, sum(strlen(extracted_text)) AS b FROM frames GROUP BY 1 ORDER BY n DESC, lang LIMIT 2) SELECT CAST(sum(n) AS BIGINT) AS matched_rows, CAST(sum(b) AS BIGINT) AS bytes FROM g")
def capture_reuse_summary(spark, d):
    return dg.reuse_summary(dg.reuse_signal(frames(spark, d), "lang", "extracted_text", 2))


@query("""WITH a AS (SELECT 'a' || event_id AS id, CASE WHEN event_id % 9 <> 0 THEN event_id // 2 END AS frame_id, event_id AS seq, ts FROM events WHERE event_id % 3 = 0 AND event_type = 'view'),
o AS (SELECT 'o' || event_id AS id, CASE WHEN event_id % 9 <> 0 THEN event_id // 2 END AS frame_id, event_id AS seq, ts FROM events WHERE event_id % 2 = 0 AND event_type = 'view'),
b AS (SELECT *, 'accessibility' AS source, -seq AS o FROM a UNION ALL SELECT *, 'ocr', seq FROM o)
SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('frame:' || frame_id, 'id:' || id) ORDER BY source, o, id) AS r FROM b WHERE ts >= TIMESTAMP '2024-01-05') WHERE r = 1 ORDER BY ts, id LIMIT 40 OFFSET 5""")
def capture_page(spark, d):
    i = F.col("frame_id")
    e = activity(spark, d).select(F.when(i % 9 != 0, F.floor(i / 2)).alias("frame_id"), i.alias("seq"), F.col("frame_timestamp").alias("ts"), "app_name")
    name = lambda p: e.withColumn("id", F.concat(F.lit(p), F.col("seq").cast("string")))
    return ig.capture_page(name("a").filter("seq % 3 = 0"), name("o").filter("seq % 2 = 0"), "2024-01-05 00:00:00", app="view", limit=40, offset=5)[0].select("id", "source")


@query("""WITH t AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'x' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t, CASE WHEN event_id % 4 > 0 THEN date_trunc('second', ts) END AS tm FROM events)
SELECT id, CAST(row_number() OVER (ORDER BY tm NULLS LAST, t, id) AS INTEGER) AS place FROM t ORDER BY place LIMIT 3000""")
def record_order(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    first = ig.in_record_order(table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("timestamp"))).limit(3000)
    return first.select("id", F.row_number().over(W.orderBy(F.asc_nulls_last(F.try_to_timestamp("timestamp")), "timestamp", "id")).alias("place"))


@query("""WITH e AS (SELECT l_orderkey AS f, l_linenumber AS n, l_linestatus AS role, l_returnflag AS text FROM lineitem), t AS (SELECT f, count(*) AS n FROM e GROUP BY 1)
SELECT event_id AS frame_id, coalesce(t.n, 0) AS nodes FROM events LEFT JOIN t ON t.f = coalesce(CASE WHEN event_id % 3 = 0 THEN event_id * 2 END, event_id)""")
def frame_trees(spark, d):
    f = activity(spark, d).select("frame_id", F.when(F.col("frame_id") % 3 == 0, F.col("frame_id") * 2).alias("elements_ref_frame_id"), F.lit("[]").alias("accessibility_tree_json"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("id"), F.col("l_linestatus").alias("role"), F.col("l_returnflag").alias("text"), F.lit(0).alias("depth"), F.col("l_linenumber").alias("sort_order"))
    return tr.frame_trees(f, e).select("frame_id", F.coalesce(F.json_array_length("accessibility_tree_json"), F.lit(0)).cast("long").alias("nodes"))


@query("""WITH p AS (SELECT count(*) AS n FROM events WHERE event_type = 'click'), t AS (SELECT count(*) AS n FROM events WHERE event_type = 'view') SELECT p.n AS predicted, t.n AS truth, round(abs(p.n - t.n)::DOUBLE / t.n, 6) AS delta FROM p, t""")
def eval_count_delta(spark, d):
    a = activity(spark, d)
    return rt.count_delta(a.filter("app_name = 'click'"), a.filter("app_name = 'view'"))


@query(f"""WITH t AS (SELECT event_id, event_type AS app, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS tm, event_id % 3 > 0 AS c, event_id % 5 > 0 AS d FROM events)
SELECT event_id, CASE WHEN c THEN '帧 ' || event_id || '：' || app || ' | w（' || tm || '），抽取规则 generic。' WHEN d THEN '原始 AX 树不可访问；仅返回派生抽取记录（抽取规则 generic）。' ELSE '未找到 frame ' || event_id || '（capture 与派生数据库均无记录）。' END AS narrative FROM t""")
def inspect_frame(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    i = F.col("event_id")
    return e.select("event_id", nv.frame(i, F.col("event_type"), F.lit("w"), F.col("ts"), F.lit("generic"), i % 3 > 0, i % 5 > 0).alias("narrative"))


# --- trees ---------------------------------------------------------------------------------------------------------------

#: Lines of a document that read alike everywhere, and its tree as a flat array: window, heading, text area with the lines, a secure field with a child, a group.
PLAIN_SQL = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[^A-Za-z0-9 .,]', '', 'g'))), lambda x: x <> '')"


def _trees(spark, d) -> DataFrame:
    node = lambda role, text, depth: F.struct(F.lit(role).alias("role"), text.alias("text"), F.lit(depth).alias("depth"))
    clean = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z0-9 .,]", ""))), lambda x: x != "")
    nothing = F.lit(None).cast("string")
    head = F.array(node("AXWindow", F.col("source"), 0), node("AXHeading", F.col("lang"), 1), node("AXTextArea", nothing, 1))
    tail = F.array(node("AXSecureTextField", F.lit("pw"), 2), node("AXStaticText", F.lit("hidden"), 3), node("AXGroup", F.lit("end"), 1))
    tree = F.to_json(F.concat(head, F.transform(clean, lambda x: node("AXStaticText", x, 2)), tail))
    broken = F.when(F.col("doc_id") % 10 == 0, "not json").when(F.col("doc_id") % 10 == 1, nothing).otherwise(tree)
    return table(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), F.col("source").alias("window_name"), broken.alias("accessibility_tree_json"))


@query(f"""SELECT doc_id AS frame_id, CASE WHEN doc_id % 10 < 2 THEN '' ELSE '[Window] ' || source || chr(10) || '[Nav] ' || lang || chr(10) || array_to_string(list_transform(list_concat({PLAIN_SQL}, ['pw', 'hidden', 'end']), lambda x: '[Body] ' || x), chr(10)) END AS text FROM documents""")
def tree_extract(spark, d):
    return _trees(spark, d).select("frame_id", tr.tree_text(F.col("accessibility_tree_json"), F.col("window_name")).alias("text"))


@query(f"SELECT doc_id AS frame_id, CASE WHEN doc_id % 10 < 2 THEN 0 ELSE len({PLAIN_SQL}) + 4 END AS n_roles, doc_id % 10 >= 2 AS secure FROM documents")
def tree_prune_json(spark, d):
    secure = ["AXSecureTextField"]
    t = _trees(spark, d).withColumn("pruned", tr.prune_json(F.col("accessibility_tree_json"), secure))
    n = F.coalesce(F.regexp_count("pruned", F.lit('"role"')), F.lit(0)).cast("long")
    return t.select("frame_id", n.alias("n_roles"), tr.holds_secure(F.col("accessibility_tree_json"), secure).alias("secure"))


@query(f"""WITH t AS (SELECT doc_id AS frame_id, len({PLAIN_SQL}) AS n FROM documents WHERE doc_id % 10 >= 2), r AS (SELECT *, CAST(i AS INTEGER) AS sort_order FROM t, unnest(range(0, n + 6)) AS u(i))
SELECT frame_id, sort_order, CASE WHEN i = 0 THEN 'AXWindow' WHEN i = 1 THEN 'AXHeading' WHEN i = 2 THEN 'AXTextArea' WHEN i = n + 3 THEN 'AXSecureTextField' WHEN i = n + 5 THEN 'AXGroup' ELSE 'AXStaticText' END AS role,
  CASE WHEN i = 0 THEN 0 WHEN i < 3 OR i = n + 5 THEN 1 WHEN i = n + 4 THEN 3 ELSE 2 END AS depth, CAST(CASE WHEN i = 0 THEN NULL WHEN i < 3 OR i = n + 5 THEN 0 WHEN i = n + 4 THEN n + 3 ELSE 2 END AS INTEGER) AS parent_order FROM r""")
def tree_to_elements(spark, d):
    return tr.element_rows(_trees(spark, d)).select("frame_id", "sort_order", "role", "depth", "parent_order")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'AXWindow' WHEN doc_id % 3 = 0 THEN 'AXGroup' WHEN coalesce(text, '') <> '' THEN 'AXWebArea' END AS role, CASE WHEN doc_id % 4 <> 2 AND doc_id % 3 <> 0 THEN nullif(text, '') END AS value FROM documents""")
def extraction_input(spark, d):
    record = F.expr("""CASE doc_id % 4 WHEN 0 THEN '' WHEN 2 THEN '{"role":"AXWindow"}' WHEN 3 THEN '  ' END""")
    frame = F.expr("""CASE doc_id % 3 WHEN 0 THEN '{"role":"AXGroup"}' WHEN 1 THEN ' ' END""")
    t = table(spark, d, "documents").select("doc_id", tr.input_tree(record, frame, F.col("text")).alias("t"))
    return t.select("doc_id", F.get_json_object("t", "$.role").alias("role"), F.get_json_object("t", "$.value").alias("value"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '[Body] ' || lang ELSE '[Body] from the tree' END AS text FROM documents")
def extraction_fallback(spark, d):
    tree = F.expr("""CASE doc_id % 3 WHEN 0 THEN '{"role":"AXSecureTextField","value":"pw"}' WHEN 1 THEN '{broken' ELSE '{"role":"AXWebArea","value":"from the tree"}' END""")
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tr.extracted_text(tree, F.lit(None).cast("string"), F.col("lang"), F.lit(None).cast("string"), ["AXSecureTextField"]).alias("text"))


# --- streams -------------------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    """A new folder for a query's checkpoint and output, among the application's intermediate tables."""
    return f"{intermediate_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name: str) -> DataFrame:
    """A table as a stream of its files, so many bytes a micro-batch."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxBytesPerTrigger", str(128 << 20)).parquet(d)


def _stream_frames(spark, d) -> DataFrame:
    """Frames as a stream of events, whose texts are looked up."""
    events = _stream(spark, d, "events").select(F.col("event_id").alias("frame_id"), F.col("ts").cast("timestamp").alias("frame_timestamp"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), "lang", F.col("text").alias("extracted_text"))
    return events.join(docs, "frame_id")


@query(SQL["session_window_equiv"])
def stream_sessions_equals_batch(spark, d):
    events = _stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("frame_timestamp"))
    out = st.run_available(st.stream_sessions(events, USER, IDLE), _folder(spark), "complete")
    return out.select("user_id", us("started_at").alias("started_us"), "frames")


@query(SQL["line_delta_batch"].replace("p.frame_id, p.lang, CAST(p.epoch AS BIGINT) AS epoch, ", "p.frame_id, p.lang AS context, CAST(p.epoch AS BIGINT) AS epoch, ").replace(", sha256(k.t) AS delta_hash", ""))
def stream_line_delta_equals_batch(spark, d):
    out = st.stream_line_delta(_stream_frames(spark, d), _folder(spark), "lang", IDLE)
    return out.select("frame_id", "context", "epoch", "kept_lines", "delta_text")


# a frame in seven fails the first time it is tried, and the first one after some time always: what comes before that is accepted in the end
STUCK = "2024-01-02 12:00:00"


@query(SQL["stream_line_delta_equals_batch"].replace("FROM p LEFT JOIN k USING (frame_id)", f"FROM p LEFT JOIN k USING (frame_id) WHERE {{'t': p.frame_timestamp, 'i': p.frame_id}} < (SELECT min({{'t': frame_timestamp, 'i': frame_id}}) FROM frames WHERE frame_timestamp >= TIMESTAMP '{STUCK}')"))
def stream_transaction(spark, d):
    stuck = table(spark, d, "events").join(table(spark, d, "documents").select(F.col("doc_id").alias("event_id")), "event_id").filter(F.col("ts") >= F.lit(STUCK).cast("timestamp_ntz"))
    first = stuck.agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("stuck"))

    def attempt(previews: DataFrame) -> DataFrame:
        again = (F.pmod("frame_id", F.lit(7)) == 3) & (F.col("attempt") < 2)
        return previews.crossJoin(F.broadcast(first)).withColumn("failed", again | F.coalesce(F.col("frame_id") == F.col("stuck"), F.lit(False)))  # one row

    out = cm.Transactions(_folder(spark), IDLE, attempt, "lang").run(_stream_frames(spark, d))
    return out.select("frame_id", "context", "epoch", "kept_lines", "delta_text")


HOLD = 3 * 86_400


# errors block a user, sign-ups unblock it, and of purchases nobody can tell: they block too
@query(f"""WITH e AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS key, ts, event_type AS t FROM events WHERE user_id IS NOT NULL), c AS (SELECT *, t <> 'signup' AS blocked FROM e WHERE t IN ('error', 'signup', 'purchase')), last AS (SELECT max(ts) AS ts FROM events),
f AS (SELECT e.id, e.key, e.ts, coalesce((SELECT max_by(blocked, {{'t': c.ts, 'i': c.id}}) FROM c WHERE c.key = e.key AND {{'t': c.ts, 'i': c.id}} < {{'t': e.ts, 'i': e.id}}), false) AS blocked,
  (SELECT min({{'t': c.ts, 'i': c.id}}) FROM c WHERE NOT c.blocked AND c.key = e.key AND {{'t': c.ts, 'i': c.id}} > {{'t': e.ts, 'i': e.id}}) AS free FROM e WHERE t IN ('click', 'view')),
s AS (SELECT *, CASE WHEN NOT blocked THEN 'passed' WHEN free.t <= ts + INTERVAL {HOLD} SECOND THEN 'released' WHEN free IS NOT NULL OR ts + INTERVAL {HOLD} SECOND < (SELECT ts FROM last) THEN 'dropped' END AS status FROM f),
r AS (SELECT *, CASE status WHEN 'passed' THEN {{'t': ts, 'i': id}} WHEN 'released' THEN free END AS w FROM s WHERE status IS NOT NULL)
SELECT key, id AS frame_id, status, epoch_us(w.t) AS released_us, CASE WHEN w IS NOT NULL THEN row_number() OVER (PARTITION BY key, w IS NULL ORDER BY w, ts, id) - 1 END AS place FROM r""")
def stream_release(spark, d):
    events = _stream(spark, d, "events").filter("user_id IS NOT NULL").select("user_id", F.col("event_id").alias("frame_id"), F.col("ts").cast("timestamp").alias("frame_timestamp"), "event_type")
    controls = events.filter("event_type IN ('error', 'signup', 'purchase')").withColumn("blocked", F.expr("CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END"))
    out = st.run_available(rl.stream_released(events.filter("event_type IN ('click', 'view')"), controls, "user_id", HOLD), _folder(spark))
    return out.select("key", "frame_id", "status", "released_us", "place")


CUT = "2024-01-02 06:00:00"


# a new stream goes on from the open sessions at a time: what it keeps of later frames is what an uninterrupted one keeps
@query(SQL["stream_line_delta_equals_batch"].replace("CAST(p.epoch AS BIGINT) AS epoch, ", "").replace("FROM p LEFT JOIN k USING (frame_id)", f"FROM p LEFT JOIN k USING (frame_id) WHERE p.frame_timestamp > TIMESTAMP '{CUT}'"))
def stream_hydrated_delta(spark, d):
    before = frames(spark, d).filter(F.col("frame_timestamp") <= F.lit(CUT).cast("timestamp"))
    open_ = ss.idle_flushed(ss.sessions_of(ss.sessionized(before, ["lang"], IDLE), ["lang"]), F.lit(CUT).cast("timestamp"), IDLE).filter("is_open")
    known = ig.hydrated(before, open_, CUT, "lang")
    later = _stream_frames(spark, d).filter(F.col("frame_timestamp") > F.lit(CUT).cast("timestamp"))
    out = st.stream_line_delta(later, _folder(spark), "lang", IDLE, known)
    return out.select("frame_id", "context", "kept_lines", "delta_text")


@query(SQL["stream_line_delta_equals_batch"])
def backlog_replay(spark, d):
    """All history, in pages of 300 rows, four to a run."""
    path = _folder(spark)
    pages = bl.paged(frames(spark, d), f"{path}/pages", 300, columns=line_columns("lang"))
    bl.replayed_in_one(spark, pages, 4, f"{path}/checkpoint", st.line_delta_of_few(path, IDLE), "size(own)")
    return spark.read.schema(st.DELTA).parquet(f"{path}/out").select("frame_id", "context", "epoch", "kept_lines", "delta_text")


# --- ranges of any number and width --------------------------------------------------------------------------------------

#: After each error a user is hidden from all for 20 minutes, and all that comes after a time is. Ranges overlap; a few are empty or end before they start.
HIDDEN_SQL = """hidden AS (SELECT ts AS f, ts + INTERVAL 20 MINUTE AS t FROM events WHERE event_type = 'error' UNION ALL SELECT ts, ts - INTERVAL 1 DAY FROM events WHERE event_type = 'view'
  UNION ALL SELECT TIMESTAMP '2024-01-28 12:00:00', TIMESTAMP '9999-12-31 00:00:00' UNION ALL SELECT ts, NULL FROM events WHERE event_type = 'click')"""


def _hidden(spark, d) -> DataFrame:
    e = activity(spark, d).withColumn("ts", F.col("frame_timestamp"))
    of = lambda app, end: e.filter(F.col("app_name") == app).select(F.col("ts").alias("from"), F.expr(end).cast("timestamp").alias("to"))
    open_ = rows(spark, [("2024-01-28 12:00:00", "9999-12-31 00:00:00")], "f string, t string").select(F.col("f").cast("timestamp").alias("from"), F.col("t").cast("timestamp").alias("to"))
    return of("error", "ts + interval 20 minutes").unionByName(of("view", "ts - interval 1 day")).unionByName(of("click", "NULL")).unionByName(open_)


@query(f"WITH {HIDDEN_SQL} SELECT event_id AS frame_id FROM events WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE ts BETWEEN f AND t)")
def ranges_points(spark, d):
    return iv.outside(activity(spark, d), _hidden(spark, d), "frame_timestamp", most=50).select("frame_id")


@query(f"WITH {NUMBERED_SQL}, {HIDDEN_SQL} SELECT session_id FROM sessions WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE f <= t AND ended_at >= f AND started_at <= t)")
def ranges_sessions(spark, d):
    return iv.outside(sessions(spark, d), _hidden(spark, d), "started_at", "ended_at", most=50).select("session_id")


@query(f"""WITH {HIDDEN_SQL}, o AS (SELECT f, t, CASE WHEN f <= max(t) OVER (ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hidden WHERE f <= t),
g AS (SELECT *, sum(new) OVER (ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT epoch_us(min(f)) AS from_us, epoch_us(max(t)) AS to_us FROM g GROUP BY g""")
def ranges_merged(spark, d):
    return iv.merged(_hidden(spark, d)).select(us("from").alias("from_us"), us("to").alias("to_us"))


# one record in five has a time that nobody can read, and one range an end: texts decide then
@query("""WITH r AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN '2024-01-1' || (event_id % 7) || ' about noon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS s, event_id % 5 > 0 AS ok FROM events), g(f, t, ok) AS (VALUES
  ('2024-01-02 00:00:00', '2024-01-03 06:00:00', true), ('2024-01-12 00:00:00', '2024-01-14 00:00:00', true), ('2024-01-20 00:00:00', '2024-01-20 someday', false))
SELECT event_id AS frame_id FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE CASE WHEN r.ok AND g.ok THEN CAST(s AS TIMESTAMP) BETWEEN CAST(CASE WHEN g.ok THEN f END AS TIMESTAMP) AND CAST(CASE WHEN g.ok THEN t END AS TIMESTAMP) ELSE s BETWEEN f AND t END)""")
def ranges_by_text(spark, d):
    text = F.when(F.col("frame_id") % 5 == 0, F.concat(F.lit("2024-01-1"), (F.col("frame_id") % 7).cast("string"), F.lit(" about noon"))).otherwise(F.date_format("frame_timestamp", "yyyy-MM-dd HH:mm:ss"))
    ranges = rows(spark, [("2024-01-02 00:00:00", "2024-01-03 06:00:00"), ("2024-01-12 00:00:00", "2024-01-14 00:00:00"), ("2024-01-20 00:00:00", "2024-01-20 someday")], "from string, to string")
    return iv.outside_by_text(activity(spark, d).withColumn("timestamp", text), ranges).select("frame_id")


# --- deletion as a whole -------------------------------------------------------------------------------------------------


def _derived(spark, d):
    """What deletes what is derived from frames: sessions of users, contents of events, vectors."""
    named = vectors(spark, d).select("vec_id", "id", F.lit(None).cast("long").alias("meta_frame_id"), F.lit("").alias("capture_id"))
    return lambda ids: de.derived_deleted(sessions(spark, d), activity(spark, d), named, ids)


def _no_tombstones(spark) -> DataFrame:
    return spark.createDataFrame([], de.TOMBSTONE)


def _counted(spark, left) -> DataFrame:
    return rows(spark, [(name, left.counts[name], t.count()) for name, t in left.tables.items()], "name string, deleted long, remaining long")


# lines of orders stand in for elements
@query(f"""WITH {NUMBERED_SQL}, x AS (SELECT event_id AS f FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10 10:00:00' AND TIMESTAMP '2024-01-12 10:00:00'), t AS (
  SELECT 'frames' AS name, event_id IN (SELECT f FROM x) AS gone FROM events UNION ALL SELECT 'elements', l_orderkey IN (SELECT f FROM x) FROM lineitem UNION ALL SELECT 'content', event_id IN (SELECT f FROM x) FROM events
  UNION ALL SELECT 'vectors', vec_id IN (SELECT f FROM x) FROM embeddings JOIN events ON vec_id = event_id UNION ALL SELECT 'sessions', bool_or(frame_id IN (SELECT f FROM x)) FROM owned GROUP BY session_id)
SELECT name, count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT gone) AS remaining FROM t GROUP BY 1""")
def delete_range_whole(spark, d):
    a = activity(spark, d)
    ids = lc.frames_in_range(a, "2024-01-10 10:00:00", "2024-01-12 10:00:00")
    left, _, failed = de.cascaded(a, _elements(spark, d), ids, _derived(spark, d), "2024-02-01", _no_tombstones(spark))
    return _counted(spark, left) if failed is None else _counted(spark, left).limit(0)


# the cascade fails once: its range is hidden, then tried again
@query("""WITH x AS (SELECT event_id, ts FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10 10:00:00' AND TIMESTAMP '2024-01-12 10:00:00')
SELECT 'hidden' AS name, count(*) FILTER (NOT ts BETWEEN (SELECT min(ts) FROM x) AND (SELECT max(ts) FROM x)) AS n FROM events UNION ALL SELECT 'failed ids', count(*) FROM x UNION ALL SELECT 'resolved', 1 UNION ALL SELECT 'unresolved', 0
UNION ALL SELECT 'content', (SELECT count(*) FROM events) - count(*) FROM x""")
def delete_range_retried(spark, d):
    a, tries, after = activity(spark, d), [], {}

    def derived(ids: DataFrame):
        tries.append(1)
        if len(tries) == 1:
            raise OSError("derived tables are locked")
        after["left"] = _derived(spark, d)(ids)
        return after["left"]

    ids = lc.frames_in_range(a, "2024-01-10 10:00:00", "2024-01-12 10:00:00")
    _, noted, _ = de.cascaded(a, _elements(spark, d), ids, derived, "2024-02-01", _no_tombstones(spark))
    hidden = se.without_suppressed_points(a, pr.unresolved(noted)).count()
    done, resolved = de.reconciled(noted, derived, "2024-02-02")
    ids_of = noted.agg(F.sum(F.size("failed_frame_ids"))).first()[0]
    return rows(spark, [("hidden", hidden), ("failed ids", ids_of), ("resolved", resolved), ("unresolved", pr.unresolved(done).count()), ("content", after["left"].tables["content"].count())], "name string, n long")


@query(SQL["retention_cut"].replace("SELECT event_id AS frame_id FROM s JOIN b", f"""SELECT * FROM (WITH {NUMBERED_SQL}, x AS (SELECT event_id AS f FROM s JOIN b""").replace("AND ts < TIMESTAMP '2024-01-20'", """AND ts < TIMESTAMP '2024-01-20'), t AS (
  SELECT 'frames' AS name, event_id IN (SELECT f FROM x) AS gone FROM events UNION ALL SELECT 'elements', l_orderkey IN (SELECT f FROM x) FROM lineitem UNION ALL SELECT 'content', event_id IN (SELECT f FROM x) FROM events
  UNION ALL SELECT 'vectors', vec_id IN (SELECT f FROM x) FROM embeddings JOIN events ON vec_id = event_id UNION ALL SELECT 'sessions', bool_or(frame_id IN (SELECT f FROM x)) FROM owned GROUP BY session_id)
SELECT name, count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT gone) AS remaining FROM t GROUP BY 1)"""))
def retention_whole(spark, d):
    sized = activity(spark, d).withColumn("bytes", F.floor(F.col("value") * 100))
    budget = sized.agg(F.floor(F.sum("bytes") / 2).alias("b")).first()["b"]
    left, _, _ = de.retained(sized, _elements(spark, d), budget, "2024-01-20 00:00:00", _derived(spark, d), "2024-02-01", _no_tombstones(spark))
    return _counted(spark, left)


# --- calls of providers --------------------------------------------------------------------------------------------------


def _embed(text: str) -> list[float]:
    """A stand-in for a provider: two numbers of a text, and no answer where the text is long and of an even length."""
    if len(text) > 400 and len(text) % 2 == 0:
        raise ConnectionError("provider is down")
    return [float(len(text)), float(text.count(" "))]


# a text in three is in the cache; every seventh frame has none
@query(f"""WITH {FRAMES_SQL}, f AS (SELECT frame_id, frame_timestamp, CASE WHEN frame_id % 7 = 0 THEN '' ELSE extracted_text END AS x FROM frames), cache AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0),
m AS (SELECT x, min({{'t': frame_timestamp, 'i': frame_id}}) AS first FROM f WHERE x <> '' AND x NOT IN (SELECT text FROM cache WHERE text IS NOT NULL) GROUP BY 1)
SELECT frame_id, CASE WHEN coalesce(f.x, '') = '' THEN 'skipped-empty' WHEN m.x IS NULL THEN 'reused-hash' WHEN length(f.x) > 400 AND length(f.x) % 2 = 0 THEN 'provider-unavailable' WHEN m.first.i = frame_id THEN 'computed' ELSE 'reused-hash' END AS outcome,
  CASE WHEN m.x IS NULL THEN NULL WHEN length(f.x) > 400 AND length(f.x) % 2 = 0 THEN 'ConnectionError: provider is down' END AS error,
  CASE WHEN coalesce(f.x, '') = '' OR (m.x IS NOT NULL AND length(f.x) > 400 AND length(f.x) % 2 = 0) THEN NULL ELSE CAST(length(f.x) AS DOUBLE) END AS chars FROM f LEFT JOIN m USING (x)""")
def embedding_outcomes(spark, d):
    hashed = lambda df: df.withColumn("text_hash", tx.text_hash(F.col("extracted_text")))
    f = hashed(frames(spark, d).withColumn("extracted_text", F.when(F.col("frame_id") % 7 == 0, "").otherwise(F.col("extracted_text"))))
    cached = hashed(table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.col("text").alias("extracted_text"))).filter("extracted_text <> ''").dropDuplicates(["text_hash"])
    cache = cached.select(F.col("text_hash").alias("hash"), F.array(F.length("extracted_text").cast("double"), F.lit(0.0)).alias("embedding"))
    out = po.embedding_outcomes(f, cache, _embed, bound=8, tasks=4)
    return out.select("frame_id", "outcome", "error", F.col("embedding")[0].alias("chars"))


def _summarize(row: dict) -> str:
    if row["frames"] % 5 == 0:
        raise TimeoutError("too slow")
    return "" if row["frames"] % 7 == 0 else f"{row['session_id']} has {row['frames']}"


#: Sessions as stored: some ready, some ready without a text, some failed before; of every eleventh nobody knows how long it was.
STORED_SQL = """st AS (SELECT session_id, user_id AS u, frames AS n, started_at, ended_at, CASE WHEN frames % 11 = 0 THEN NULL ELSE active END AS active, CASE frames % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'ready' ELSE 'pending' END AS status,
  CASE WHEN frames % 4 < 2 THEN 'old text' END AS text FROM sessions)"""
ISO_SQL = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


# of users with odd numbers capture is paused, and of every third one nobody can tell; session ids that don't exist are asked for, too
@query(f"""WITH {NUMBERED_SQL}, {STORED_SQL}, x AS (SELECT *, NOT (u % 2 = 1 OR u % 3 = 0) AS free, status = 'ready' AND text IS NOT NULL AS ready,
  CASE WHEN active IS NOT NULL THEN '在 app 中工作约 ' || CAST(floor(active / 60 + 0.5) AS BIGINT) || ' 分钟，围绕 "c"，共 ' || n || ' 帧证据（' || {ISO_SQL.format('started_at')} || '起，' || {ISO_SQL.format('ended_at')} || '止）。' END AS template,
  CASE WHEN n % 5 > 0 AND n % 7 > 0 THEN session_id || ' has ' || n END AS said FROM st),
y AS (SELECT session_id, CASE WHEN ready OR (free AND said IS NOT NULL) THEN 'ready' WHEN template IS NULL THEN 'failed' WHEN free THEN 'degraded' ELSE 'ready' END AS summary_status, * EXCLUDE (session_id) FROM x)
SELECT session_id, summary_status, CASE WHEN summary_status = 'failed' OR ready THEN text WHEN free AND said IS NOT NULL THEN said ELSE template END AS summary_text,
  CASE WHEN NOT ready AND free AND said IS NOT NULL THEN 'llm' ELSE 'template' END AS summary_provider_kind, NOT ready AS stored FROM y WHERE u IS NOT NULL
UNION ALL SELECT 'gone#' || event_id, 'failed', NULL, 'template', false FROM events WHERE event_type = 'signup'""")
def summaries_ensured(spark, d):
    s = sessions(spark, d).filter("user_id IS NOT NULL").withColumns({
        "app_name": F.lit("app"), "context_label": F.lit("c"), "active_seconds": F.expr("CASE WHEN frames % 11 > 0 THEN active_seconds END"),
        "summary_status": F.expr("CASE frames % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'ready' ELSE 'pending' END"), "summary_text": F.expr("CASE WHEN frames % 4 < 2 THEN 'old text' END"),
        "summary_provider_kind": F.lit(None).cast("string"), "summary_generated_at": F.lit(None).cast("timestamp"),
    })
    gone = activity(spark, d).filter("app_name = 'signup'").select(F.concat(F.lit("gone#"), F.col("frame_id").cast("string")).alias("session_id"))
    out = None
    for part, paused in (("user_id % 2 = 1", F.lit(True)), ("user_id % 2 = 0 AND user_id % 3 = 0", F.lit(None).cast("boolean")), ("user_id % 2 = 0 AND user_id % 3 <> 0", F.lit(False))):
        own = s.filter(part)
        wanted = own.select("session_id") if out is not None else own.select("session_id").unionByName(gone)
        made = su.ensured(wanted, own, _summarize, "llm", paused, F.lit("2024-02-01").cast("timestamp"), bound=4, tasks=2)
        out = made if out is None else out.unionByName(made)
    return out.select("session_id", "summary_status", "summary_text", "summary_provider_kind", "stored")
