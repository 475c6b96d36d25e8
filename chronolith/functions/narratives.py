"""Sentences that results carry, as Column expressions. Their wording, which consumers compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .values import half_up, iso

NO_EVIDENCE = "未找到匹配证据。"
NO_SESSIONS = "该时段内未发现会话。"


def minutes(seconds: Column) -> Column:
    return half_up(seconds / 60).cast("long")


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def shares(pairs: Column, unit: str = "", mark: str = ", ") -> Column:
    """`name: count` of an array of (name, n), by count downwards, then name."""
    ordered = F.sort_array(F.transform(pairs, lambda p: F.struct((-p["n"]).alias("o"), p["name"].alias("name"), p["n"].alias("n"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat(p["name"], F.lit(": "), p["n"].cast("string"), F.lit(unit))), mark)


def of_hits(hits: DataFrame) -> DataFrame:
    """One row (hits, narrative) from hits (app_name, session_id), which a limit has made few."""
    per_app = hits.groupBy(F.coalesce("app_name", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"), F.collect_set("session_id").alias("s"))
    one = per_app.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.size(F.array_distinct(F.flatten(F.collect_list("s")))).alias("sessions"), F.collect_list(F.struct("name", "n")).alias("apps"))
    text = _said("找到 ", F.col("hits"), " 条证据，分布在 ", F.col("sessions"), " 个会话中（", shares(F.col("apps")), " 应用）。")
    return one.select("hits", F.when(F.col("hits") == 0, NO_EVIDENCE).otherwise(text).alias("narrative"))


def of_sessions(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """One row (sessions, narrative) from sessions (app_name, active_seconds)."""
    app = F.coalesce(F.nullif("app_name", F.lit("")), F.lit("unknown"))
    one = sessions.agg(F.count("*").alias("sessions"), F.sum("active_seconds").alias("_s"), F.array_join(F.sort_array(F.collect_set(app)), ", ").alias("_a"))
    text = _said(f"在 {start} 至 {end} 内有 ", F.col("sessions"), " 个会话，覆盖 ", F.col("_a"), " 应用，总活跃 ", minutes(F.col("_s")), " 分钟。")
    return one.select("sessions", F.when(F.col("sessions") == 0, NO_SESSIONS).otherwise(text).alias("narrative"))


def of_blocks(blocks: DataFrame, start: str, end: str) -> DataFrame:
    """One row (blocks, narrative) from blocks (seconds)."""
    one = blocks.agg(F.count("*").alias("blocks"), F.sum("seconds").alias("_s"))
    text = _said(f"在 {start} 至 {end} 内分布于 ", F.col("blocks"), " 个时段，总活跃 ", minutes(F.col("_s")), " 分钟。")
    return one.select("blocks", F.when(F.col("blocks") == 0, NO_SESSIONS).otherwise(text).alias("narrative"))


def block(sessions: Column, seconds: Column, by_app: Column) -> Column:
    """Of one hour or day: by_app is an array of (name, seconds)."""
    by_seconds = F.sort_array(F.transform(by_app, lambda p: F.struct((-p["seconds"]).alias("o"), p["name"].alias("name"), p["seconds"].alias("s"))))
    apps = F.array_join(F.transform(by_seconds, lambda p: F.concat(p["name"], F.lit(": "), minutes(p["s"]).cast("string"), F.lit(" 分"))), "；")
    return _said("该时段共 ", sessions, " 个会话（", apps, "），活跃 ", minutes(seconds), " 分钟。")


def session(app: Column, label: Column, start: Column, end: Column, seconds: Column, frames: Column) -> Column:
    shown = F.coalesce(F.nullif(app, F.lit("")), F.lit("unknown"))
    return _said("会话 ", shown, " | ", label, "（", iso(start), " → ", iso(end), "，", F.greatest(F.lit(1), minutes(seconds)), " 分钟，", frames, " 帧）。")


def summary(app: Column, label: Column, start: Column, end: Column, seconds: Column, frames: Column) -> Column:
    return _said("在 ", app, " 中工作约 ", minutes(seconds), ' 分钟，围绕 "', label, '"，共 ', frames, " 帧证据（", iso(start), "起，", iso(end), "止）。")


def frame(frame_id: Column, app: Column, window: Column, ts: Column, rule: Column, captured: Column, derived: Column, upstream: str = "capture") -> Column:
    """Of one frame: captured and derived say which of its two records exist."""
    text = _said("帧 ", frame_id, "：", F.coalesce(app, F.lit("unknown")), " | ", F.coalesce(window, F.lit("")), "（", iso(ts), "），抽取规则 ", F.coalesce(rule, F.lit("n/a")), "。")
    return (
        F.when(captured, text)
        .when(derived, _said("原始 AX 树不可访问；仅返回派生抽取记录（抽取规则 ", F.coalesce(rule, F.lit("n/a")), "）。"))
        .otherwise(_said("未找到 frame ", frame_id, f"（{upstream} 与派生数据库均无记录）。"))
    )
