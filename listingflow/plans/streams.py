"""Streaming twins of the batch operators; each must equal a batch statement."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import fixtures as X
from ..operators import health, outbox, search
from ..registry import query
from ..session import work_path
from ..sources.tables import table
from ..streaming import health as stream_health_ops, records
from ..streaming.reconcile import StreamingState
from ..streaming.runner import add_to_table, drain, stream_of, utc_events, with_rocksdb
from .common import ACC, CARRY, DENSE, as_of, cte, day, obs_timeline
from .sequences import HEALTH_CTE, HISTORY, STATE, change_text


#: Events land in steps that end within a day; such a run comes in two batches.
CUTS = ["2024-01-10 07:00:00", "2024-01-20 19:00:00"]
_STEP = "+".join(f"IF(ts >= TIMESTAMP_NTZ '{c}', 1, 0)" for c in CUTS)


def landings(spark, sf, again: str = "0 hours", close_after: str | None = None, reports: bool = False):
    """The folder in which events land step by step; each step also brings once more what came ``again`` before its cut.

    ``close_after`` ends with a row that holds a time alone, as a source's heartbeat does: so long after the end of the last day.  It moves the
    watermark past that day and stands in the window of the next one, which stays open.  With ``reports``, runs that found nothing
    land too, each by its report.
    """
    events, landing = table(spark, sf, "events"), work_path(spark, "landing")
    if reports:
        events = events.unionByName(X.zero_run_reports(events))
    for step in range(len(CUTS) + 1):
        new = F.expr(_STEP) == step
        if step:
            cut = f"TIMESTAMP_NTZ '{CUTS[step - 1]}'"
            new = new | F.expr(f"ts >= {cut} - INTERVAL {again} AND ts < {cut}")
        events.filter(new).write.mode("append").parquet(landing)
        yield stream_of(spark, landing, events)
    if close_after:
        end = F.expr(f"CAST(date_add(CAST(MAX(ts) AS DATE), 1) AS TIMESTAMP_NTZ) + INTERVAL {close_after}").alias("ts")
        beat = events.agg(end).select(*[F.col("ts").cast(kind).alias(c) if c == "ts" else F.lit(None).cast(kind).alias(c) for c, kind in events.dtypes])
        beat.write.mode("append").parquet(landing)
        yield stream_of(spark, landing, events)


def in_steps(spark, sf, name, make, delay="1 hour", again="0 hours", partition_by=(), close=False, reports=False):
    """The rows a stream gives while events land in three steps, cut within days; ``close`` also closes the last day."""
    out = work_path(spark, name)
    with with_rocksdb(spark):
        for landed in landings(spark, sf, again, delay if close else None, reports):
            rows = add_to_table(make(utc_events(landed).withWatermark("ts", delay)), out, list(partition_by))
    return rows


@query("stream_dedupe", "SELECT event_id, user_id, event_type, value FROM events")
def stream_dedupe(spark, sf):
    # Every event is delivered twice at once, and the last 20 hours of each step come again with the next one; the state
    # forgets ids once the watermark passed them.
    def once(e):
        twice = e.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
        return twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type", "value")
    return in_steps(spark, sf, "stream-dedupe", once, "1 day", "20 hours")


def reconciled(spark, sf):
    """Events landed in three steps: the first half, the rest, and a late replay."""
    events = table(spark, sf, "events")
    landing, checkpoint = work_path(spark, "landing"), work_path(spark, "reconcile-checkpoint")
    state = StreamingState(spark, work_path(spark, "reconcile"), X.observations, X.run_evidence,
                           F.expr("user_id % 10"), F.to_date("ts"))
    # the first step ends in the middle of a day: that run comes in two batches
    middle, late = "ts < TIMESTAMP_NTZ '2024-01-16 11:00:00'", "ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-07 00:00:00'"
    for step in (middle, f"NOT ({middle})", late):
        events.filter(step).write.mode("append").parquet(landing)
        drain(stream_of(spark, landing, events), state.apply, checkpoint)
    return state


# A run is closed, and judged, once the watermark (an hour behind the newest event) has passed its day.
LANDED = "landed AS (SELECT * FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(MAX(ts) - INTERVAL 1 HOUR AS DATE) FROM events))"
_OBS, _RUNS = (x.replace("FROM events", "FROM landed") for x in (X.OBS, X.RUNS))
CLOSED_RUNS = (LANDED, _OBS, _RUNS, X.LISTED_ONLY_SEEN, X.ACCEPTED, CARRY, DENSE)
#: Rule of the stream's new-record events, on carried fields.
MATCHING = ("m1", "m3")


def stream_outputs(spark, sf, close=False):
    """Outputs of the keyed reconcile."""
    return in_steps(spark, sf, "records", lambda e: records.reconcile_stream(
        X.stream_observations(e), X.stream_runs(e), lambda r: r["match_text"] in MATCHING, buckets=2), partition_by=["part"], close=close)


@query("stream_reconcile", cte(X.OBS, X.RUNS, X.LISTED_ONLY_SEEN, X.ACCEPTED, CARRY, DENSE, STATE) + """
SELECT s.source_id, s.job_key, s.first_seen, s.last_seen, s.missing_count, s.status, c.title, c.department,
       CAST(c.deadline AS VARCHAR) AS deadline, c.deadline_type, c.source_closed
FROM state s JOIN carried c ON c.source_id = s.source_id AND c.job_key = s.job_key AND c.run_date = s.last_date""")
def stream_reconcile(spark, sf):
    """State over all runs, the last day's too."""
    return records.state_of(stream_outputs(spark, sf, close=True)).select(
        "source_id", "job_key", "first_seen", "last_seen", "missing_count", "status", "title", "department",
        "deadline", "deadline_type", "source_closed")


QUEUED = f"""
first_runs AS (SELECT source_id, run_date, COALESCE(SUM(CASE WHEN n_jobs > 0 OR (listing_complete AND explicit_empty) THEN 1 ELSE 0 END)
   OVER (PARTITION BY source_id ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS baseline FROM listed),
queued AS (SELECT d.source_id, d.job_key, MIN(d.run_date) AS created_at FROM dense d
   JOIN firsts f ON f.source_id = d.source_id AND f.job_key = d.job_key
   JOIN first_runs b ON b.source_id = d.source_id AND b.run_date = f.first_seen AND NOT b.baseline
   WHERE d.present AND d.detail_complete AND d.status = 'open' AND d.match_text IN {MATCHING} GROUP BY 1, 2)
"""


@query("stream_history", cte(*CLOSED_RUNS, HISTORY, QUEUED) + """
SELECT source_id, job_key, CAST(happened AS VARCHAR) AS happened, kind, title, changes FROM history
UNION ALL SELECT source_id, job_key, CAST(created_at AS VARCHAR), 'queued', NULL, '' FROM queued""")
def stream_history(spark, sf):
    """History and new-record events, which the keyed state gives in the same pass."""
    rows = stream_outputs(spark, sf).where("part IN ('history', 'outbox')")
    queued = F.col("part") == "outbox"
    return rows.select("source_id", "job_key", F.col("at").alias("happened"), F.when(queued, "queued").otherwise(F.col("kind")).alias("kind"),
                       "title", F.when(queued, "").otherwise(change_text()).alias("changes"))


@query("outbox_enqueue", cte(*ACC, CARRY, DENSE, QUEUED) + """
SELECT 'new:' || source_id || '-' || job_key AS event_id, CAST(created_at AS VARCHAR) AS created_at FROM queued""")
def outbox_enqueue(spark, sf):
    """Events of every record's first sighting that is whole, open and matching, unless it belongs to a baseline."""
    return outbox.enqueue(obs_timeline(spark, sf), F.col("match_text").isin(*MATCHING)).select(
        F.concat(F.lit("new:"), "source_id", F.lit("-"), "job_key").alias("event_id"), day("created_at").alias("created_at"))


@query("stream_late", cte(X.OBS) + """
SELECT late, COUNT(*) AS n FROM (SELECT FALSE AS late FROM obs UNION ALL
  SELECT FALSE FROM (SELECT user_id % 10, CAST(json_extract_string(props, '$.k') AS INT) % 20 FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-16'
    GROUP BY 1, 2 HAVING MIN(ts) < TIMESTAMP '2024-01-16 11:00:00' AND MAX(ts) >= TIMESTAMP '2024-01-16 11:00:00') split UNION ALL
  SELECT TRUE FROM obs WHERE run_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-06') x GROUP BY 1""")
def stream_late(spark, sf):
    # Runs older than the open one never regress the state; they are left out and counted.
    # A record of the run that comes in two batches is counted in both.
    return reconciled(spark, sf).late_counts().groupBy("late").agg(F.sum("n").alias("n"))


@query("stream_outbox", """
WITH q AS (SELECT user_id, MIN(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'signup' GROUP BY 1),
held AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'sent' ELSE 'suppressed' END AS state FROM events WHERE user_id % 4 < 2 GROUP BY 1, 2)
SELECT 'new:' || COALESCE(q.user_id, h.user_id) AS event_id, CASE WHEN h.state = 'sent' THEN 'sent' WHEN q.user_id IS NULL THEN h.state ELSE 'pending' END AS state,
       CASE WHEN COALESCE(h.state, '') <> 'sent' THEN CAST(q.d AS VARCHAR) END AS created_at
FROM q FULL OUTER JOIN held h ON h.user_id = q.user_id""")
def stream_outbox(spark, sf):
    """Queueing through a stream: an id that is pending or sent is never queued again."""
    events = table(spark, sf, "events")
    path = work_path(spark, "outbox")
    held = events.filter("user_id % 4 < 2").select("user_id").distinct().select(
        F.concat(F.lit("new:"), "user_id").alias("event_id"),
        F.when(F.col("user_id") % 4 == 0, "sent").otherwise("suppressed").alias("state"),
        F.lit(None).cast("date").alias("created_at"), F.lit(-1).cast("bigint").alias("seq"))
    held.write.parquet(path + "/batch=-1")

    def current(upto):
        rows = spark.read.parquet(path).filter(F.col("batch") < upto)
        return rows.groupBy("event_id").agg(F.max_by(F.struct("state", "created_at"), "seq").alias("r")).select(
            "event_id", "r.*")

    def apply(batch, batch_id):
        wanted = batch.filter("event_type = 'signup'").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("created_at"))
        wanted = wanted.select(F.concat(F.lit("new:"), "user_id").alias("event_id"), "created_at")
        live = current(batch_id).filter(F.col("state").isin("pending", "sent")).select("event_id")
        fresh = wanted.join(live, "event_id", "left_anti").withColumn("state", F.lit("pending")).withColumn(
            "seq", F.lit(batch_id).cast("bigint"))
        # Named by the batch, so a repeated batch replaces its own rows.
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    for landed in landings(spark, sf):
        drain(landed, apply, path + "-checkpoint")
    return current(2**62).withColumn("created_at", day("created_at"))


_CLOSED = """
e AS (SELECT user_id % 10 AS source_id, ts, CAST(ts + INTERVAL 8 HOUR AS DATE) AS d, event_type FROM events),
mx AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS wm FROM events),
h0 AS (SELECT source_id, d, ROUND(CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 4) AS err_ratio FROM e GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN err_ratio <= 0.15 THEN 'ok' WHEN err_ratio <= 0.25 THEN 'partial' ELSE 'error' END AS status FROM h0
      WHERE CAST(d AS TIMESTAMP) + INTERVAL 16 HOUR <= (SELECT wm FROM mx))
"""


@query("stream_health", cte(*HEALTH_CTE) + """
SELECT event_id, source_id, CAST(created_at AS VARCHAR) AS created_at, status, severity, capability, change FROM trans""")
def stream_health(spark, sf):
    """Transitions over all runs, as ``health_transitions`` has them: runs without a row and the last day's too."""
    def events(e):
        runs = X.with_errors(records.judged(X.stream_runs(e)))
        return stream_health_ops.transitions(health.graded(runs))
    return in_steps(spark, sf, "stream-health", events, close=True, reports=True)


@query("stream_digest", "WITH " + _CLOSED.strip() + """
SELECT CAST(d AS VARCHAR) AS day, COUNT(*) AS n_problems FROM h WHERE status <> 'ok' GROUP BY 1""")
def stream_digest(spark, sf):
    """One digest per closed local day: sources that were not well."""
    rows = in_steps(spark, sf, "stream-digest", lambda e: stream_health_ops.daily_health(
        e.select(F.expr("user_id % 10").alias("source_id"), "ts", "event_type")))
    return rows.filter("status <> 'ok'").groupBy("day").agg(F.count("*").alias("n_problems"))


@query("stream_stale", f"""
WITH wm AS (SELECT MAX(ts) - INTERVAL 1 HOUR AS wm FROM events),
r AS (SELECT user_id AS source_id, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS listed FROM events GROUP BY 1, 2
      HAVING ROUND(CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 4) <= 0.25),
c AS (SELECT *, LEAD(listed) OVER (PARTITION BY source_id ORDER BY listed) AS again FROM r WHERE listed <= (SELECT wm FROM wm))
SELECT source_id, strftime(listed, '%Y-%m-%d %H:%M:%S') AS last_listing, strftime(listed + INTERVAL {V.STALE_AFTER_HOURS} HOUR, '%Y-%m-%d %H:%M:%S') AS stale_from
FROM c WHERE COALESCE(again > listed + INTERVAL {V.STALE_AFTER_HOURS} HOUR, listed + INTERVAL {V.STALE_AFTER_HOURS} HOUR <= (SELECT wm FROM wm))""")
def stream_stale(spark, sf):
    """Times at which sources went stale: no complete listing for so long, silent sources included."""
    rows = in_steps(spark, sf, "stream-stale", lambda e: stream_health_ops.stale_spells(X.stream_runs(e, "user_id")))
    at = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("source_id", at("last_listing"), at("stale_from"))


@query("stream_retention", cte(X.ADS) + f""", f AS (SELECT id, COALESCE(posted_date, CAST(first_seen + INTERVAL 8 HOUR AS DATE)) AS d FROM ads)
SELECT id, CAST(d AS VARCHAR) AS effective_date FROM f WHERE d > CAST('{X.AS_OF}' AS DATE) - {V.FEED_DAYS}""")
def stream_retention(spark, sf):
    """Rolling feed: each batch lands by day, the reader keeps the thirty days up to its as-of day."""
    path = work_path(spark, "feed")

    def apply(batch, batch_id):
        rows = X.ads_of(batch).select("id", search.effective_date().alias("effective_date"))
        # Replacing the batch's own folder makes a repeated delivery harmless.
        rows.write.mode("overwrite").partitionBy("effective_date").parquet(f"{path}/batch={batch_id}")

    documents, landing = table(spark, sf, "documents"), work_path(spark, "landing")
    for step in range(3):
        documents.filter(F.pmod("doc_id", F.lit(3)) == step).write.mode("append").parquet(landing)
        drain(stream_of(spark, landing, documents), apply, path + "-checkpoint")
    feed = spark.read.schema("id string, batch bigint, effective_date date").parquet(path)
    # The cut-off is a given day, so it prunes folders and a future date moves nothing.
    return feed.filter(F.col("effective_date") > F.date_sub(as_of(), V.FEED_DAYS)).select(
        "id", day("effective_date").alias("effective_date"))
