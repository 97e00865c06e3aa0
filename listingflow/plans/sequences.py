"""Window and sequence logic over runs."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import fixed_values as V
from .. import fixtures as X
from ..operators import health, lifecycle, listing, reconcile
from ..operators.running import longest_streaks, range_rank
from ..registry import query
from ..sources.tables import table
from .common import ACC, CARRY, DENSE, accepted_runs, cte, day, joined, obs_timeline


@query("dedupe_last", """
SELECT user_id AS id, event_id, event_type, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1""")
def dedupe_last(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", "value")
    return reconcile.dedupe(e, "id", "event_id", "last")


@query("dedupe_first", """
SELECT user_id AS id, event_id, event_type, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) x WHERE rn = 1""")
def dedupe_first(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", "value")
    return reconcile.dedupe(e, "id", "event_id", "first")


@query("seen_span", cte(X.OBS) + """
SELECT source_id, job_key, CAST(MIN(run_date) AS VARCHAR) AS first_seen, CAST(MAX(run_date) AS VARCHAR) AS last_seen,
       COUNT(*) AS n_seen FROM obs GROUP BY 1, 2""")
def seen_span(spark, sf):
    # Runs at which a record was seen, not its deliveries, so the day grain comes first.
    return X.obs(spark, sf).groupBy("source_id", "job_key").agg(
        day(F.min("run_date")).alias("first_seen"), day(F.max("run_date")).alias("last_seen"),
        F.count("*").alias("n_seen"))


@query("baseline_flag", cte(X.RUNS) + """
SELECT source_id, CAST(run_date AS VARCHAR) AS run_date, explicit_empty, n_jobs,
       COALESCE(SUM(CASE WHEN n_jobs > 0 OR (listing_complete AND explicit_empty) THEN 1 ELSE 0 END) OVER
         (PARTITION BY source_id ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS baseline
FROM (SELECT source_id, run_date, listing_complete, n_events % 7 = 1 AS explicit_empty,
             CASE WHEN n_events % 3 < 2 AND run_date < DATE '2024-01-12' THEN 0 ELSE n_jobs END AS n_jobs FROM runs) r""")
def baseline_flag(spark, sf):
    r = X.runs(spark, sf).withColumn("explicit_empty", F.expr("n_events % 7 = 1")).withColumn(
        "n_jobs", F.expr("CASE WHEN n_events % 3 < 2 AND run_date < DATE '2024-01-12' THEN 0 ELSE n_jobs END"))
    return lifecycle.baseline_runs(r).select(
        "source_id", day("run_date").alias("run_date"), "explicit_empty", "n_jobs", "baseline")


@query("missing_count", cte(*ACC, CARRY, DENSE) + """
SELECT source_id, job_key, CAST(o_date AS VARCHAR) AS seen, MAX(missing_count)::BIGINT AS missed,
       CAST(MIN(CASE WHEN missing_count = 3 THEN run_date END) AS VARCHAR) AS missing_since
FROM stat GROUP BY 1, 2, 3""")
def missing_count(spark, sf):
    spells = lifecycle.absence_spells(lifecycle.carry_forward(X.obs(spark, sf)), accepted_runs(spark, sf))
    return spells.select("source_id", "job_key", day("run_date").alias("seen"),
                         F.col("missed").cast("bigint").alias("missed"), day("missing_since").alias("missing_since"))


@query("volume_drop_guard", cte(X.VOL_RUNS, """
runs AS (SELECT *, n_jobs AS n_events, 0.0 AS err_ratio, 'ok' AS status, TRUE AS listing_complete FROM vol_runs)""", X.LISTED, X.ACCEPTED) + """
SELECT source_id, CAST(run_date AS VARCHAR) AS run_date, n_jobs, accepted, guarded FROM accepted""")
def volume_drop_guard(spark, sf):
    runs = X.with_zero_runs(X.vol_runs(spark, sf).withColumn("listing_complete", F.lit(True)))
    return listing.volume_fold(runs).select(
        "source_id", day("run_date").alias("run_date"), "n_jobs", "accepted", "guarded")


@query("carry_forward", cte(X.OBS, CARRY) + """
SELECT source_id, job_key, CAST(run_date AS VARCHAR) AS run_date, detail_complete, title, department,
       CAST(posted_date AS VARCHAR) AS posted_date, CAST(deadline AS VARCHAR) AS deadline, deadline_type,
       CAST(detail_verified_at AS VARCHAR) AS detail_verified_at, description, match_text, employment_type, deadline_raw,
       listing_fingerprint, detail_refresh_failed FROM carried""")
def carry_forward(spark, sf):
    return lifecycle.carry_forward(X.obs(spark, sf)).select(
        "source_id", "job_key", day("run_date").alias("run_date"), "detail_complete", "title", "department",
        day("posted_date").alias("posted_date"), day("deadline").alias("deadline"), "deadline_type",
        day("detail_verified_at").alias("detail_verified_at"), "description", "match_text", "employment_type", "deadline_raw",
        "listing_fingerprint", "detail_refresh_failed")


@query("closure_latch", cte(X.OBS, CARRY) + """
SELECT c.source_id, c.job_key, CAST(c.run_date AS VARCHAR) AS run_date, o.source_closed AS read_closed, c.source_closed
FROM carried c JOIN obs o ON o.source_id = c.source_id AND o.job_key = c.job_key AND o.run_date = c.run_date""")
def closure_latch(spark, sf):
    o = X.obs(spark, sf).withColumn("read", F.col("source_closed"))
    latched = F.last(F.when(F.col("detail_complete") | F.col("source_closed"), F.col("source_closed")),
                     ignorenulls=True).over(lifecycle._history(o))
    return o.select("source_id", "job_key", day("run_date").alias("run_date"), F.col("read").alias("read_closed"),
                    F.coalesce(latched, F.lit(False)).alias("source_closed"))


STATE = """
state AS (SELECT source_id, job_key, CAST(MIN(run_date) AS VARCHAR) AS first_seen, CAST(MAX(o_date) AS VARCHAR) AS last_seen,
                 CAST(arg_max(missing_count, run_date) AS BIGINT) AS missing_count, arg_max(status, run_date) AS status,
                 CAST(MAX(o_date) AS DATE) AS last_date, MAX(run_date) AS last_run FROM dense GROUP BY 1, 2)
"""


@query("job_status", cte(*ACC, CARRY, DENSE, STATE) + """
SELECT s.source_id, s.job_key, s.first_seen, s.last_seen, s.missing_count, s.status, c.title, c.department,
       CAST(c.deadline AS VARCHAR) AS deadline, c.deadline_type, c.source_closed, c.description, c.detail_refresh_failed
FROM state s JOIN carried c ON c.source_id = s.source_id AND c.job_key = s.job_key AND c.run_date = s.last_date""")
def job_status(spark, sf):
    return lifecycle.current_state(obs_timeline(spark, sf)).select(
        "source_id", "job_key", day("first_seen").alias("first_seen"), day("last_seen").alias("last_seen"),
        F.col("missing_count").cast("bigint").alias("missing_count"), "status", "title", "department",
        day("deadline").alias("deadline"), "deadline_type", "source_closed", "description", "detail_refresh_failed")


@query("expire_jobs", cte(X.ADS) + """
SELECT doc_id, status AS before_status,
       (deadline_type = 'closing' AND deadline < DATE '2024-03-01' AND status <> 'closed') AS expired,
       CASE WHEN deadline_type = 'closing' AND deadline < DATE '2024-03-01' THEN 'closed' ELSE status END AS status
FROM ads""")
def expire_jobs(spark, sf):
    a = X.ads(spark, sf).withColumn("before_status", F.col("status"))
    return lifecycle.expire(a, F.lit("2024-03-01").cast("date")).select("doc_id", "before_status", "expired", "status")


HISTORY = """
seen AS (SELECT source_id, job_key, run_date, title, department, posted_date, deadline, deadline_type, status, prev_status,
   description, employment_type, match_text, deadline_raw, LAG(description) OVER w AS b_description,
   LAG(employment_type) OVER w AS b_employment, LAG(match_text) OVER w AS b_match, LAG(deadline_raw) OVER w AS b_raw,
   LAG(title) OVER w AS b_title, LAG(department) OVER w AS b_department, LAG(posted_date) OVER w AS b_posted,
   LAG(deadline) OVER w AS b_deadline, LAG(deadline_type) OVER w AS b_type, ROW_NUMBER() OVER w AS nth
   FROM dense WHERE present WINDOW w AS (PARTITION BY source_id, job_key ORDER BY run_date)),
base AS (SELECT source_id, run_date, COALESCE(SUM(CASE WHEN n_jobs > 0 OR (listing_complete AND explicit_empty) THEN 1 ELSE 0 END)
   OVER (PARTITION BY source_id ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS baseline FROM listed),
history AS (
  SELECT s.source_id, s.job_key, s.run_date AS happened,
         CASE WHEN nth > 1 THEN 'updated' WHEN r.baseline THEN 'baseline' ELSE 'new' END AS kind, title,
         CASE WHEN nth = 1 THEN '' ELSE array_to_string(list_filter([
           CASE WHEN deadline IS DISTINCT FROM b_deadline THEN 'deadline:' || COALESCE(CAST(b_deadline AS VARCHAR), '-') || '>' || COALESCE(CAST(deadline AS VARCHAR), '-') END,
           CASE WHEN deadline_type IS DISTINCT FROM b_type THEN 'deadline_type:' || COALESCE(b_type, '-') || '>' || COALESCE(deadline_type, '-') END,
           CASE WHEN department IS DISTINCT FROM b_department THEN 'department:' || COALESCE(b_department, '-') || '>' || COALESCE(department, '-') END,
           CASE WHEN description IS DISTINCT FROM b_description THEN 'description:' || COALESCE(b_description, '-') || '>' || COALESCE(description, '-') END,
           CASE WHEN employment_type IS DISTINCT FROM b_employment THEN 'employment_type:' || COALESCE(b_employment, '-') || '>' || COALESCE(employment_type, '-') END,
           CASE WHEN posted_date IS DISTINCT FROM b_posted THEN 'posted_date:' || COALESCE(CAST(b_posted AS VARCHAR), '-') || '>' || COALESCE(CAST(posted_date AS VARCHAR), '-') END,
           CASE WHEN status IS DISTINCT FROM prev_status THEN 'status:' || COALESCE(prev_status, '-') || '>' || status END,
           CASE WHEN title IS DISTINCT FROM b_title THEN 'title:' || COALESCE(b_title, '-') || '>' || COALESCE(title, '-') END
         ], lambda x: x IS NOT NULL), '|') END AS changes
  FROM seen s JOIN base r ON r.source_id = s.source_id AND r.run_date = s.run_date
  WHERE nth = 1 OR status <> prev_status OR title IS DISTINCT FROM b_title OR department IS DISTINCT FROM b_department
     OR description IS DISTINCT FROM b_description OR employment_type IS DISTINCT FROM b_employment
     OR match_text IS DISTINCT FROM b_match OR deadline_raw IS DISTINCT FROM b_raw
     OR posted_date IS DISTINCT FROM b_posted OR deadline IS DISTINCT FROM b_deadline OR deadline_type IS DISTINCT FROM b_type
  UNION ALL
  SELECT d.source_id, d.job_key, d.run_date, 'status', o.title, 'status:' || d.prev_status || '>' || d.status
  FROM dense d JOIN carried o ON o.source_id = d.source_id AND o.job_key = d.job_key AND o.run_date = d.o_date
  WHERE NOT d.present AND d.status <> d.prev_status)
"""


def history_rows(spark, sf):
    return lifecycle.change_history(obs_timeline(spark, sf))


def change_text():
    return joined(F.transform("changes", lambda c: F.concat(
        c["field"], F.lit(":"), F.coalesce(c["before"], F.lit("-")), F.lit(">"), F.coalesce(c["after"], F.lit("-")))))


@query("change_history", cte(*ACC, CARRY, DENSE, HISTORY) + """
SELECT source_id, job_key, CAST(happened AS VARCHAR) AS happened, kind, title, changes FROM history""")
def change_history(spark, sf):
    return history_rows(spark, sf).select("source_id", "job_key", day("at").alias("happened"), "kind", "title",
                                          change_text().alias("changes"))


@query("content_changed_at", cte(*ACC, CARRY, DENSE, HISTORY) + """
SELECT source_id, job_key, CAST(MAX(happened) AS VARCHAR) AS changed_at FROM history GROUP BY 1, 2""")
def content_changed_at(spark, sf):
    return lifecycle.current_state(obs_timeline(spark, sf)).select(
        "source_id", "job_key", day("changed_at").alias("changed_at"))


def health_state(spark, sf):
    """Health rows: severity and status by the decision table, plus the signature."""
    return health.graded(listing.volume_fold(X.health_runs(spark, sf)))


HEALTH = """
hv AS (SELECT a.source_id, a.run_date, a.n_jobs, a.guarded, a.accepted, h.capability, h.error_set, h.institution, a.err_ratio,
              a.accepted AND a.err_ratio <= 0.15 AS complete, h.capability IN ('manual', 'pending') AS silent
       FROM accepted a JOIN health_runs h ON h.source_id = a.source_id AND h.run_date = a.run_date),
hs AS (SELECT *, CASE WHEN guarded OR (NOT accepted AND NOT silent) THEN 'error' WHEN complete THEN 'ok'
                      WHEN silent OR (accepted AND capability IN ('list_only', 'partial')) THEN 'warning' ELSE 'error' END AS severity
       FROM hv),
health AS (SELECT *, CASE WHEN severity = 'warning' AND silent THEN capability WHEN complete THEN 'ok'
                          WHEN n_jobs > 0 OR accepted THEN 'partial' ELSE 'error' END AS status FROM hs),
sig AS (SELECT *, substr(sha256(status || chr(31) || severity || chr(31) || capability || chr(31) || error_set), 1, 16) AS signature
        FROM health),
prev AS (SELECT *, LAG(signature) OVER (PARTITION BY source_id ORDER BY run_date) AS before FROM sig),
trans AS (SELECT 'health:' || source_id || ':' || CAST(run_date AS VARCHAR) || ':' || signature AS event_id, source_id, institution,
                 run_date AS created_at, status, severity, capability, error_set,
                 CASE WHEN status = 'ok' THEN 'recovered' WHEN before IS NULL THEN 'started' ELSE 'changed' END AS change
          FROM prev WHERE signature IS DISTINCT FROM before AND NOT (before IS NULL AND status = 'ok'))
"""
HEALTH_CTE = (X.HEALTH_RUNS, X.ACCEPTED, HEALTH)


@query("health_transitions", cte(*HEALTH_CTE) + """
SELECT event_id, source_id, CAST(created_at AS VARCHAR) AS created_at, status, severity, capability, change FROM trans""")
def health_transitions(spark, sf):
    return health.transitions(health_state(spark, sf)).select(
        "event_id", "source_id", day("created_at").alias("created_at"), "status", "severity", "capability", "change")


SETTLED = """
nowst AS (SELECT source_id, arg_max(status, run_date) AS now_status FROM health GROUP BY 1),
settled AS (SELECT t.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY t.source_id ORDER BY created_at DESC, event_id DESC) > 1 THEN 'superseded'
                             WHEN n.now_status = 'ok' AND t.change <> 'recovered' THEN 'resolved' ELSE 'pending' END AS state
            FROM trans t LEFT JOIN nowst n ON n.source_id = t.source_id)
"""


def settled_events(spark, sf):
    h = health_state(spark, sf)
    current = reconcile.latest_state(h.select("source_id", "run_date", "status"), ["source_id"], F.col("run_date"))
    return health.settle_pending(health.transitions(h), current)


@query("newest_pending", cte(*HEALTH_CTE, SETTLED) + """
SELECT event_id, source_id, change, state FROM settled""")
def newest_pending(spark, sf):
    return settled_events(spark, sf).select("event_id", "source_id", "change", "state")


@query("failure_streaks", """
WITH e AS (SELECT user_id % 10 AS source_id, CAST(ts AS DATE) AS run_date, ts, event_id, event_type = 'error' AS bad FROM events),
g AS (SELECT *, SUM(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, run_date ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM e),
s AS (SELECT source_id, run_date, island, SUM(CASE WHEN bad THEN 1 ELSE 0 END)::BIGINT AS n FROM g GROUP BY 1, 2, 3)
SELECT source_id, CAST(run_date AS VARCHAR) AS run_date, MAX(n)::BIGINT AS longest, MAX(n) >= 3 AS stopped FROM s GROUP BY 1, 2""")
def failure_streaks(spark, sf):
    e = table(spark, sf, "events").select(
        F.expr("user_id % 10").alias("source_id"), F.to_date("ts").alias("run_date"), "ts", "event_id", "event_type")
    return longest_streaks(e, ["source_id", "run_date"], ["ts", "event_id"], F.col("event_type") == "error").select(
        "source_id", day("run_date").alias("run_date"), "longest", (F.col("longest") >= V.FAILURE_STOP).alias("stopped"))


@query("latest_run", cte(X.RUNS) + """
SELECT source_id, CAST(run_date AS VARCHAR) AS run_date, n_events, n_jobs, status FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY run_date DESC) AS rn FROM runs) x WHERE rn = 1""")
def latest_run(spark, sf):
    return reconcile.latest_state(X.runs(spark, sf), ["source_id"], F.col("run_date")).select(
        "source_id", day("run_date").alias("run_date"), "n_events", "n_jobs", "status")


PRIORITY = """
lst AS (SELECT source_id, job_key, title, department, deadline_type, detail_complete, run_date, event_id,
               LAG(title) OVER w AS o_title, LAG(department) OVER w AS o_department, LAG(deadline_type) OVER w AS o_type,
               LAG(detail_complete) OVER w AS o_complete, LAG(run_date) OVER w AS o_date
        FROM obs WINDOW w AS (PARTITION BY source_id, job_key ORDER BY run_date)),
lastobs AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id, job_key ORDER BY run_date DESC) AS rn FROM lst) x WHERE rn = 1),
ver AS (SELECT source_id, job_key, MAX(run_date) AS verified FROM obs WHERE detail_complete GROUP BY 1, 2),
pri AS (SELECT l.*, v.verified, substr(sha256(l.source_id || ':' || l.job_key), 1, 24) AS id,
               CASE WHEN o_title IS NULL THEN 0 WHEN title <> o_title OR department <> o_department OR deadline_type <> o_type THEN 1
                    WHEN NOT o_complete THEN 2 ELSE 3 END AS priority
        FROM lastobs l LEFT JOIN ver v ON v.source_id = l.source_id AND v.job_key = l.job_key)
"""


@query("refresh_priority", cte(X.OBS, PRIORITY) + """
SELECT source_id, job_key, priority, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY priority,
       CASE WHEN priority = 3 THEN verified END NULLS FIRST, id) AS position FROM pri""")
def refresh_priority(spark, sf):
    w = Window.partitionBy("source_id", "job_key").orderBy("run_date")
    finger = F.concat_ws("|", "title", "department", "deadline_type")
    o = X.obs(spark, sf).withColumn("fingerprint", finger)
    o = o.withColumn("old", F.lag(F.struct("fingerprint", "detail_complete", F.lit(False).alias("refresh_failed"))).over(w))
    last = o.groupBy("source_id", "job_key").agg(
        F.max_by(F.struct("fingerprint", "old"), "run_date").alias("r"),
        F.max(F.when(F.col("detail_complete"), F.col("run_date"))).alias("verified"))
    rows = last.select("source_id", "job_key", "r.*", "verified").withColumn(
        "priority", reconcile.refresh_priority()).withColumn(
        "id", F.substring(F.sha2(F.concat_ws(":", "source_id", "job_key"), 256), 1, 24))
    never = F.lit("1970-01-01").cast("date")
    order = [F.col("priority"), F.coalesce(F.when(F.col("priority") == 3, F.col("verified")), never), F.col("id")]
    return range_rank(rows, order, "position", ["source_id"]).select("source_id", "job_key", "priority", "position")
