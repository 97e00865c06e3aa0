"""Aggregations."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import fixed_values as V
from .. import fixtures as X
from ..operators import health, lifecycle, listing
from ..operators.running import top_per_key
from ..registry import query
from ..sources import payloads
from ..sources.tables import table
from .common import ACC, CARRY, DENSE, cte, day, joined, obs_timeline
from .sequences import HEALTH_CTE, HISTORY, STATE, health_state, history_rows


@query("batch_summary", cte(X.OBS, X.RUNS, X.LISTED, "fs AS (SELECT source_id, job_key, MIN(run_date) AS f FROM obs GROUP BY 1, 2)") + """
SELECT r.source_id, CAST(r.run_date AS VARCHAR) AS run_date, r.explicit_empty, COUNT(DISTINCT o.job_key) AS n_records,
       SUM(CASE WHEN o.detail_complete THEN 1 ELSE 0 END)::BIGINT AS n_complete,
       CASE WHEN COUNT(o.job_key) > 0 THEN ROUND(CAST(SUM(CASE WHEN o.detail_complete THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(o.job_key), 4)
            WHEN r.explicit_empty AND r.listing_complete THEN 1.0::DOUBLE END AS coverage,
       SUM(CASE WHEN fs.f = o.run_date THEN 1 ELSE 0 END)::BIGINT AS n_new
FROM listed r LEFT JOIN obs o ON o.source_id = r.source_id AND o.run_date = r.run_date
LEFT JOIN fs ON fs.source_id = o.source_id AND fs.job_key = o.job_key GROUP BY 1, 2, 3, r.listing_complete""")
def batch_summary(spark, sf):
    o = X.obs(spark, sf)
    # obs has one row per record and run, so plain counts are distinct counts.
    per_run = o.groupBy("source_id", "run_date").agg(
        F.count("*").alias("n_records"), F.count_if("detail_complete").alias("n_complete"))
    new = o.groupBy("source_id", "job_key").agg(F.min("run_date").alias("run_date")).groupBy(
        "source_id", "run_date").agg(F.count("*").alias("n_new"))
    runs = X.listed_runs(spark, sf)
    covered = F.when(F.col("n_records") > 0, F.round(F.col("n_complete") / F.col("n_records"), 4)).when(
        F.col("explicit_empty") & F.col("listing_complete"), 1.0)
    joined_runs = runs.join(per_run, ["source_id", "run_date"], "left").join(new, ["source_id", "run_date"], "left")
    zero = F.lit(0)
    return joined_runs.select(
        "source_id", day("run_date").alias("run_date"), "explicit_empty", F.coalesce("n_records", zero).alias("n_records"),
        F.coalesce("n_complete", zero).alias("n_complete"), covered.alias("coverage"), F.coalesce("n_new", zero).alias("n_new"))


@query("listing_completeness", """
WITH p AS (SELECT l_orderkey AS listing_id, COUNT(*) AS n_rows, COUNT(DISTINCT l_linenumber) AS n_pages, COUNT(DISTINCT l_partkey) AS n_refs,
                  MIN(l_linenumber) AS first_page, MAX(l_linenumber) AS last_page FROM lineitem GROUP BY 1),
pg AS (SELECT listing_id, MAX(n) AS largest FROM (SELECT l_orderkey AS listing_id, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) x GROUP BY 1),
ov AS (SELECT listing_id, SUM(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS n_overlap FROM
        (SELECT l_orderkey AS listing_id, l_partkey, COUNT(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1, 2) y GROUP BY 1)
SELECT p.listing_id, n_rows, n_pages, n_refs, array_to_string(list_filter([
    CASE WHEN first_page <> 1 OR last_page <> n_pages THEN 'pages missing' END,
    CASE WHEN n_overlap > 0 THEN 'id repeated across pages' END,
    CASE WHEN n_refs <> n_rows THEN 'count differs from total' END,
    CASE WHEN largest > 1 THEN 'page size inconsistent' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM p JOIN pg ON pg.listing_id = p.listing_id JOIN ov ON ov.listing_id = p.listing_id""")
def listing_completeness(spark, sf):
    e = listing.listing_evidence(X.listing_pages(spark, sf), page_size=F.lit(1).cast("bigint"))
    return e.select("listing_id", "n_rows", "n_pages", "n_refs", joined(F.col("reasons"), "; ").alias("reasons"))


@query("listing_completeness_declared", """
WITH c AS (SELECT conv_id, COUNT(*) AS n, MIN(turn) AS lo, MAX(turn) AS hi, COUNT(DISTINCT turn) AS d FROM conversations GROUP BY 1)
SELECT conv_id AS listing_id, n AS n_rows, lo = 0 AND hi + 1 = d AND n = d AS whole FROM c""")
def listing_completeness_declared(spark, sf):
    """Conversations as listings: every page declares the total of the last page."""
    c = table(spark, sf, "conversations")
    total = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("declared"))
    pages = c.join(total, "conv_id").select(F.col("conv_id").alias("listing_id"), (F.col("turn") + 1).alias("page"),
                                            F.col("turn").alias("ref"), "declared")
    return listing.listing_evidence(pages, total=F.col("declared"), page_size=F.lit(1).cast("bigint")).select(
        "listing_id", "n_rows", "whole")


_PAYLOAD_PAGES = """
l AS (SELECT l_orderkey AS listing_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r, COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
g AS (SELECT listing_id, (r - 1) // 2 + 1 AS page, n, CASE WHEN listing_id % 7 = 3 AND r = 3 THEN 1 ELSE r END AS ref FROM l),
r AS (SELECT *, n + CASE WHEN listing_id % 7 = 1 OR (listing_id % 7 = 0 AND page > 1) THEN 1 ELSE 0 END AS declared FROM g WHERE NOT (listing_id % 7 = 2 AND page = 1)),
lost AS (SELECT DISTINCT listing_id FROM g WHERE listing_id % 7 = 2 AND page = 1),
ov AS (SELECT listing_id, COUNT(*) AS n_overlap FROM (SELECT listing_id, ref FROM r GROUP BY 1, 2 HAVING COUNT(DISTINCT page) > 1) x GROUP BY 1),
e AS (SELECT listing_id, COUNT(*) AS n_rows, COUNT(DISTINCT page) AS n_pages, COUNT(DISTINCT ref) AS n_refs, MIN(page) AS lo_page, MAX(page) AS hi_page,
             MIN(declared) AS lo, MAX(declared) AS hi FROM r GROUP BY 1)
"""


@query("listing_payload_totals", cte(_PAYLOAD_PAGES) + """
SELECT i.listing_id, COALESCE(n_rows, 0) AS n_rows, COALESCE(n_pages, 0) AS n_pages, array_to_string(list_filter([
    CASE WHEN lo <> hi THEN 'total changed' END, CASE WHEN lo_page <> 1 OR hi_page <> n_pages THEN 'pages missing' END,
    CASE WHEN n_overlap > 0 THEN 'id repeated across pages' END, CASE WHEN n_refs <> hi THEN 'count differs from total' END,
    CASE WHEN (hi + 1) // 2 <> n_pages THEN 'page size inconsistent' END, CASE WHEN t.listing_id IS NOT NULL THEN 'page refused' END], lambda x: x IS NOT NULL), '; ') AS reasons
FROM (SELECT DISTINCT listing_id FROM g) i LEFT JOIN e USING (listing_id) LEFT JOIN ov USING (listing_id) LEFT JOIN lost t USING (listing_id)""")
def listing_payload_totals(spark, sf):
    """Orders as listings of JSON pages of two rows: totals that change or do not hold, ids on two pages, refused pages."""
    w = Window.partitionBy("listing_id")
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("listing_id"), "l_linenumber")
    l = l.withColumn("r", F.row_number().over(w.orderBy("l_linenumber"))).withColumn("n", F.count("*").over(w))
    case, page = F.col("listing_id") % 7, F.floor((F.col("r") - 1) / 2) + 1
    ref = F.when((case == 3) & (F.col("r") == 3), 1).otherwise(F.col("r"))
    # a page holds two rows
    pages = l.withColumn("page", page).groupBy("listing_id", "page", "n").agg(
        F.collect_list(F.struct(ref.cast("string").alias("id"), F.lit("").alias("title"))).alias("requisitions"))
    declared = F.col("n") + F.when((case == 1) | ((case == 0) & (F.col("page") > 1)), 1).otherwise(0)
    payload = F.to_json(F.struct(F.when((case == 2) & (F.col("page") == 1), "Busy").otherwise("Success").alias("status"),
                                 F.struct(declared.alias("totalCount"), "requisitions").alias("data")))
    e = payloads.proved_listings(pages.select("listing_id", "page", payload.alias("payload")), "payload", F.lit(2).cast("bigint"))
    zero = F.lit(0)
    return e.select("listing_id", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_pages", zero).alias("n_pages"),
                    joined(F.col("reasons"), "; ").alias("reasons"))


@query("page_size_profile", """
WITH g AS (SELECT l_orderkey AS listing_id, l_linenumber AS page, COUNT(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey AS listing_id, COUNT(DISTINCT l_partkey) AS n_refs FROM lineitem GROUP BY 1)
SELECT g.listing_id, string_agg(page || ':' || n, ',' ORDER BY page) AS sizes, SUM(n)::BIGINT AS n_rows, MAX(n_refs) AS n_refs
FROM g JOIN r ON r.listing_id = g.listing_id GROUP BY 1""")
def page_size_profile(spark, sf):
    p = listing.page_profile(X.listing_pages(spark, sf))
    sizes = F.transform("sizes", lambda s: F.concat_ws(":", s["page"], s["n"]))
    return p.select("listing_id", joined(sizes, ",").alias("sizes"), "n_rows", "n_refs")


@query("run_status_rollup", cte(*HEALTH_CTE) + """
SELECT CAST(run_date AS VARCHAR) AS run_date, COUNT(*) AS n_sources, CASE WHEN BOOL_OR(severity = 'error') THEN 'partial'
       WHEN BOOL_OR(severity = 'warning') THEN 'degraded' ELSE 'ok' END AS run_status FROM health GROUP BY 1""")
def run_status_rollup(spark, sf):
    return health.run_rollup(health_state(spark, sf)).withColumn("run_date", day("run_date"))


@query("errors_distinct_cap", """
WITH e AS (SELECT user_id % 10 AS source_id, 'record ' || (user_id % 40) || ' unreadable' AS message, MIN(event_id) AS first_at
           FROM events WHERE event_type = 'error' GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY first_at) AS rn FROM e)
SELECT source_id, string_agg(message, '; ' ORDER BY first_at) AS errors, COUNT(*) AS n_kept FROM r WHERE rn <= 8 GROUP BY 1""")
def errors_distinct_cap(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'").select(
        F.expr("user_id % 10").alias("source_id"), F.expr("'record ' || (user_id % 40) || ' unreadable'").alias("message"), "event_id")
    firsts = e.groupBy("source_id", "message").agg(F.min("event_id").alias("first_at"))
    kept = top_per_key(firsts, ["source_id"], [F.col("first_at")], V.ERRORS_KEPT)
    return kept.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct("first_at", "message"))).alias("m"), F.count("*").alias("n_kept")).select(
        "source_id", joined(F.transform("m", lambda x: x["message"]), "; ").alias("errors"), "n_kept")


@query("source_metrics", """
SELECT user_id % 10 AS source_id, COUNT(*) AS requests, SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS cache_hits,
       SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS detail_fetches FROM events GROUP BY 1""")
def source_metrics(spark, sf):
    return table(spark, sf, "events").groupBy(F.expr("user_id % 10").alias("source_id")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("event_type") == "view").alias("cache_hits"),
        F.count_if(F.col("event_type") == "click").alias("detail_fetches"))


DIGEST = """
dl AS (SELECT run_date AS day, 1 AS part FROM health WHERE status <> 'ok'
       UNION ALL SELECT created_at, 0 FROM trans WHERE change = 'recovered')
"""


@query("digest_counts", cte(*HEALTH_CTE, DIGEST) + """
SELECT CAST(day AS VARCHAR) AS day, SUM(part)::BIGINT AS n_problems, SUM(1 - part)::BIGINT AS n_recoveries FROM dl GROUP BY 1""")
def digest_counts(spark, sf):
    h = health_state(spark, sf)
    lines = health.digest_lines(h, health.transitions(h))
    return lines.groupBy(day("day").alias("day")).agg(
        F.count_if(F.col("part") == 1).alias("n_problems"), F.count_if(F.col("part") == 0).alias("n_recoveries"))


@query("event_set_hash", cte(*HEALTH_CTE) + """
SELECT CAST(created_at AS VARCHAR) AS day, COUNT(*) AS n_events, CASE WHEN extract('day' FROM created_at) < 10 THEN 'health-digest:' || CAST(created_at AS VARCHAR)
  ELSE 'health-changes:' || substr(sha256(string_agg(event_id, '|' ORDER BY event_id)), 1, 20) END AS aggregate_id FROM trans GROUP BY created_at""")
def event_set_hash(spark, sf):
    # At most one transition per source and day, so the set is as large as the dimension.
    t = health.transitions(health_state(spark, sf)).groupBy("created_at").agg(
        F.collect_set("event_id").alias("ids"), F.count("*").alias("n_events"))
    return t.select(day("created_at").alias("day"), "n_events", health.aggregate_id(
        F.col("created_at"), F.dayofmonth("created_at") >= 10, F.col("ids")).alias("aggregate_id"))


@query("change_kind_counts", cte(*ACC, CARRY, DENSE, HISTORY) + """
SELECT kind, CAST(happened AS VARCHAR) AS day, COUNT(*) AS n FROM history GROUP BY 1, 2""")
def change_kind_counts(spark, sf):
    return history_rows(spark, sf).groupBy("kind", day("at").alias("day")).agg(F.count("*").alias("n"))


@query("status_totals", cte(*ACC, CARRY, DENSE, STATE) + """
SELECT source_id, status, COUNT(*) AS n FROM state GROUP BY 1, 2""")
def status_totals(spark, sf):
    return lifecycle.current_state(obs_timeline(spark, sf)).groupBy("source_id", "status").agg(F.count("*").alias("n"))
