"""Sorts, limits and budgets.  Ranks are columns, so the order itself can be checked."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import fixtures as X
from ..operators import health, search
from ..operators.running import newest_first, range_rank, top_per_key
from ..registry import query
from ..sources.tables import table
from .common import ACC, CARRY, DENSE, cte, day
from .filters import SQL_EFFECTIVE, gate_inputs
from .sequences import HEALTH_CTE, STATE, health_state


@query("sort_newest", cte(X.ADS) + f"""
SELECT id, CAST({SQL_EFFECTIVE} AS VARCHAR) AS effective_date, ROW_NUMBER() OVER (ORDER BY {SQL_EFFECTIVE} DESC, id) AS by_newest,
       ROW_NUMBER() OVER (ORDER BY CASE WHEN deadline_type = 'closing' THEN deadline END ASC NULLS LAST, id) AS by_deadline FROM ads""")
def sort_newest(spark, sf):
    a = X.ads(spark, sf).select("id", search.effective_date().alias("effective"),
                                search.date_basis("deadline").alias("closing"))
    soonest = F.coalesce(F.datediff("closing", F.lit("1970-01-01").cast("date")), F.lit(2**31 - 1))
    a = range_rank(a, [newest_first(F.col("effective")), F.col("id")], "by_newest")
    return range_rank(a, [soonest, F.col("id")], "by_deadline").select(
        "id", day("effective").alias("effective_date"), "by_newest", "by_deadline")


@query("pending_order", cte(*HEALTH_CTE, X.OBS, CARRY, DENSE, STATE, """
p AS (SELECT 'new:' || source_id || '-' || job_key AS event_id, 'new' AS kind, first_seen AS created_at FROM state
      UNION ALL SELECT DISTINCT 'health-digest:' || CAST(created_at AS VARCHAR), 'health_digest', CAST(created_at AS VARCHAR) FROM trans)""") + """
SELECT event_id, kind, created_at, ROW_NUMBER() OVER (ORDER BY CASE WHEN kind = 'new' THEN 0 ELSE 1 END, created_at, event_id) AS position FROM p""")
def pending_order(spark, sf):
    new, _ = gate_inputs(spark, sf)
    digests = health.transitions(health_state(spark, sf)).select("created_at").distinct().select(
        F.concat(F.lit("health-digest:"), day("created_at")).alias("event_id"), F.lit("health_digest").alias("kind"), "created_at")
    pending = new.select("event_id", F.lit("new").alias("kind"), "created_at").unionByName(digests)
    order = [(F.col("kind") != "new").cast("int"), F.col("created_at"), F.col("event_id")]
    return range_rank(pending, order, "position").select("event_id", "kind", day("created_at").alias("created_at"), "position")


@query("problem_order", cte(*HEALTH_CTE) + """,
p AS (SELECT run_date, source_id * 3 + 2 AS source_id, severity, 'Institution ' || source_id % 4 AS institution FROM health WHERE status <> 'ok')
SELECT CAST(run_date AS VARCHAR) AS day, source_id, severity, ROW_NUMBER() OVER (PARTITION BY run_date ORDER BY CASE WHEN severity = 'error' THEN 0 ELSE 1 END,
       institution, source_id) AS position FROM p""")
def problem_order(spark, sf):
    # Several sources of one institution; ids of one and of two digits follow as numbers.
    p = health_state(spark, sf).filter("status <> 'ok'").withColumn(
        "institution", F.concat(F.lit("Institution "), (F.col("source_id") % 4).cast("string"))).withColumn(
        "source_id", F.col("source_id") * 3 + 2)
    grade = F.when(F.col("severity") == "error", 0).otherwise(1)
    return range_rank(p.select("run_date", "source_id", "severity", "institution"),
                      [grade, F.col("institution"), F.col("source_id")], "position", ["run_date"]).select(
        day("run_date").alias("day"), "source_id", "severity", "position")


@query("budget_topk", f"""
SELECT source_id, event_id, position FROM (
  SELECT user_id % 10 AS source_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS position FROM events) x
WHERE position <= {V.REQUEST_BUDGET}""")
def budget_topk(spark, sf):
    e = table(spark, sf, "events").select(F.expr("user_id % 10").alias("source_id"), "ts", "event_id")
    return top_per_key(e, ["source_id"], [F.col("ts"), F.col("event_id")], V.REQUEST_BUDGET, "position").select(
        "source_id", "event_id", F.col("position").cast("bigint").alias("position"))


DIGEST_LINES = """
raw AS (SELECT run_date AS day, 1 AS part, CASE WHEN severity = 'error' THEN 0 ELSE 1 END AS grade, institution, source_id,
          CASE WHEN severity = 'error' THEN '⚠️ ' ELSE 'ℹ️ ' END || institution || '：' ||
          CASE capability WHEN 'manual' THEN '需手動查看；' WHEN 'pending' THEN '尚未接入；' WHEN 'list_only' THEN '只有清單；' WHEN 'partial' THEN '部分內容未接入；' ELSE '' END ||
          CASE WHEN error_set = '' THEN '尚未取得完整資料' WHEN contains(error_set, 'list not read') THEN 'list not read' ELSE 'details failed' END AS line
        FROM health WHERE status <> 'ok'
        UNION ALL SELECT created_at, 0, 0, institution, source_id, '✅ ' || institution || '：已恢復完整檢索' FROM trans WHERE change = 'recovered'),
cntd AS (SELECT day, COUNT(*) AS n_lines, SUM(part)::BIGINT AS n_problems, SUM(1 - part)::BIGINT AS n_recoveries FROM raw GROUP BY 1),
ordd AS (SELECT r.*, c.n_lines, c.n_problems, c.n_recoveries, '職位檢索每日摘要｜' || CAST(r.day AS VARCHAR) || chr(10) || '未完整來源 ' || c.n_problems || ' 個；恢復完整 ' || c.n_recoveries || ' 個。' || chr(10) AS header,
           ROW_NUMBER() OVER (PARTITION BY r.day ORDER BY part, grade, institution, source_id) AS pos FROM raw r JOIN cntd c ON c.day = r.day),
used AS (SELECT *, length(header) + SUM(length(line) + 1) OVER (PARTITION BY day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS chars FROM ordd),
incl AS (SELECT *, MAX(chars) OVER (PARTITION BY day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {limit} AS included FROM used)
"""


@query("digest_budget", cte(*HEALTH_CTE, DIGEST_LINES.format(limit=200)) + """
SELECT CAST(day AS VARCHAR) AS day, pos, line, included FROM incl""")
def digest_budget(spark, sf):
    h = health_state(spark, sf)
    lines = health.digest_lines(h, health.transitions(h))
    header = F.length(health.digest_header(F.lit(True), F.col("day")))
    return health.within_budget(lines, header, 200).select(
        day("day").alias("day"), F.col("pos").cast("bigint").alias("pos"), "line", "included")
