"""Listing-shaped views of the test tables, in Spark and (for the checks) in SQL.

The test tables hold no job advertisements, so the views give them that shape:
every row of a source table takes part, nothing is sampled or cut.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .sources.tables import table, text_table

AS_OF = "2024-04-01"

# ---------------------------------------------------------------------------
# obs: the last observation per (source, job, day), with listing fields


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return observations(table(spark, sf, "events"))


def observations(events: DataFrame) -> DataFrame:
    e = events.withColumn("run_date", F.to_date("ts"))
    return _observation_fields(_last_event(e, "run_date"))


def _last_event(events: DataFrame, when) -> DataFrame:
    e = events.withColumn("source_id", F.expr("user_id % 10")).withColumn(
        "job_key", F.expr("CAST(get_json_object(props, '$.k') AS INT) % 20"))
    # Partial aggregation, not a window: repeated deliveries of one hot job shrink
    # to one row per task before the shuffle.  (ts, event_id) is unique.
    return e.groupBy("source_id", "job_key", when).agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("o"))


def stream_observations(events: DataFrame) -> DataFrame:
    """Observations of closed days of a watermarked stream."""
    days = _last_event(events, F.window("ts", "1 day").alias("w"))
    return _observation_fields(days.withColumn("run_date", F.to_date("w.start")))


#: Event type of a row that stands for a run itself: it names no record; its ``props`` say what the run's list proves.
REPORT = "listing_report"


def stream_runs(events: DataFrame, source: str = "user_id % 10") -> DataFrame:
    """Listing evidence of closed days of a watermarked stream; ``w`` is the day.

    Rows of type ``REPORT`` are no events.  A run that found nothing is known by its report alone: it has no jobs, and is whole or
    empty as far as the report says so.  The rows of a run that found some decide on it themselves.
    """
    report, job = F.col("event_type").eqNullSafe(REPORT), F.col("n") > 0
    said = lambda what: F.coalesce(F.bool_or(report & (F.get_json_object("props", f"$.{what}") == "true")), F.lit(False))
    e = events.withColumn("source_id", F.expr(source)).withColumn(
        "job_key", F.expr("CAST(get_json_object(props, '$.k') AS INT) % 20"))
    per_job = e.groupBy(F.window("ts", "1 day").alias("day"), "source_id", "job_key").agg(
        F.count_if(~report).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"),
        said("explicit_empty").alias("empty"), said("listing_complete").alias("whole"))
    r = per_job.groupBy(F.window("day", "1 day").alias("w"), "source_id").agg(
        F.count_if(job).alias("n_jobs"), F.round(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.0)), 4).alias("err_ratio"),
        F.bool_or("empty").alias("empty"), F.bool_or("whole").alias("whole"))
    none = F.col("n_jobs") == 0
    return r.select("w", "source_id", F.to_date("w.start").alias("run_date"), "n_jobs", "err_ratio",
                    F.when(none, F.col("whole")).otherwise(F.expr("err_ratio <= 0.25D")).alias("listing_complete"),
                    (none & F.col("empty")).alias("explicit_empty"), F.expr(_CAPABILITY).alias("capability"))


def zero_run_reports(events: DataFrame) -> DataFrame:
    """The runs without a row of ``with_zero_runs`` as rows of the events' table, each the report of its run at noon."""
    ends = events.groupBy(F.expr("user_id % 10").alias("source_id")).agg(
        F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    zero = ends.withColumn("_o", F.explode(F.expr("array(-2, -1, 1, 2, 3)"))).withColumn("explicit_empty", F.expr(_SAYS_EMPTY))
    values = {"ts": F.expr("CAST(date_add(IF(_o < 0, lo, hi), _o) AS TIMESTAMP_NTZ) + INTERVAL 12 HOURS"), "user_id": F.col("source_id"),
              "event_type": F.lit(REPORT),
              "props": F.to_json(F.struct("explicit_empty", F.expr(_SAYS_WHOLE).alias("listing_complete")))}
    return zero.select(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in events.dtypes])


def _observation_fields(last: DataFrame) -> DataFrame:
    return last.select(
        "source_id", "job_key", "run_date", F.col("o.event_id").alias("event_id"),
        F.col("o.event_type").alias("title"), F.col("o.value").alias("value"),
        F.expr("CASE WHEN o.event_id % 4 = 0 THEN '' ELSE concat('D', o.event_id % 3) END").alias("department"),
        F.expr("CASE WHEN o.event_id % 3 <> 0 THEN date_sub(run_date, CAST(o.event_id % 5 AS INT)) END").alias("posted_date"),
        F.expr("CASE o.event_id % 4 WHEN 0 THEN 'closing' WHEN 1 THEN 'unknown' WHEN 2 THEN 'review' "
               "ELSE 'screening-or-closing' END").alias("deadline_type"),
        F.expr("CASE WHEN o.event_id % 4 IN (0, 2) THEN date_add(run_date, CAST(o.event_id % 10 AS INT) - 2) END").alias("deadline"),
        F.expr("o.event_type <> 'error'").alias("detail_complete"),
        F.expr("o.event_type = 'purchase' AND o.event_id % 5 = 0").alias("source_closed"),
        F.expr("CASE WHEN o.event_id % 6 = 0 THEN '' ELSE concat('Duties ', o.event_id % 6) END").alias("description"),
        F.expr("concat('m', o.event_id % 4)").alias("match_text"),
        F.expr("CASE o.event_id % 3 WHEN 0 THEN 'part-time' WHEN 1 THEN 'full-time' ELSE 'unknown' END").alias("employment_type"),
        F.expr("CASE WHEN o.event_id % 4 IN (0, 2) THEN concat('until ', o.event_id % 10) END").alias("deadline_raw"),
        F.expr("CASE WHEN o.event_id % 3 <> 0 THEN concat('f', o.event_id % 3) END").alias("listing_fingerprint"),
        F.expr("o.event_type = 'error' AND o.event_id % 2 = 0").alias("detail_refresh_failed"))


OBS = """
obs AS (
  SELECT source_id, job_key, run_date, event_id, event_type AS title, value,
         CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('D', event_id % 3) END AS department,
         CASE WHEN event_id % 3 <> 0 THEN run_date - CAST(event_id % 5 AS INT) END AS posted_date,
         CASE event_id % 4 WHEN 0 THEN 'closing' WHEN 1 THEN 'unknown' WHEN 2 THEN 'review'
              ELSE 'screening-or-closing' END AS deadline_type,
         CASE WHEN event_id % 4 IN (0, 2) THEN run_date + (CAST(event_id % 10 AS INT) - 2) END AS deadline,
         event_type <> 'error' AS detail_complete,
         (event_type = 'purchase' AND event_id % 5 = 0) AS source_closed,
         CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('Duties ', event_id % 6) END AS description,
         concat('m', event_id % 4) AS match_text,
         CASE event_id % 3 WHEN 0 THEN 'part-time' WHEN 1 THEN 'full-time' ELSE 'unknown' END AS employment_type,
         CASE WHEN event_id % 4 IN (0, 2) THEN concat('until ', event_id % 10) END AS deadline_raw,
         CASE WHEN event_id % 3 <> 0 THEN concat('f', event_id % 3) END AS listing_fingerprint,
         (event_type = 'error' AND event_id % 2 = 0) AS detail_refresh_failed
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id, job_key, run_date
                                     ORDER BY ts DESC, event_id DESC) AS rn
        FROM (SELECT user_id % 10 AS source_id,
                     CAST(json_extract_string(props, '$.k') AS INT) % 20 AS job_key,
                     CAST(ts AS DATE) AS run_date, ts, event_id, event_type, value FROM events) e0) e1
  WHERE rn = 1)
"""

# ---------------------------------------------------------------------------
# runs: one row per (source, day) with listing evidence


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_evidence(table(spark, sf, "events"))


def run_evidence(events: DataFrame) -> DataFrame:
    e = events.select(
        F.expr("user_id % 10").alias("source_id"), F.to_date("ts").alias("run_date"), "event_type",
        F.expr("CAST(get_json_object(props, '$.k') AS INT) % 20").alias("job_key"))
    per_job = e.groupBy("source_id", "run_date", "job_key").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    r = per_job.groupBy("source_id", "run_date").agg(
        F.sum("n").alias("n_events"), F.count("*").alias("n_jobs"),
        F.round(F.sum("bad") / F.sum("n"), 4).alias("err_ratio"))
    return r.select("*", F.expr("err_ratio <= 0.25D").alias("listing_complete"),
                    F.expr("CASE WHEN err_ratio <= 0.15D THEN 'ok' WHEN err_ratio <= 0.25D THEN 'partial' "
                           "ELSE 'error' END").alias("status"))


RUNS = """
runs AS (
  SELECT source_id, run_date, n_events, n_jobs, err_ratio, err_ratio <= 0.25 AS listing_complete,
         CASE WHEN err_ratio <= 0.15 THEN 'ok' WHEN err_ratio <= 0.25 THEN 'partial' ELSE 'error' END AS status
  FROM (SELECT user_id % 10 AS source_id, CAST(ts AS DATE) AS run_date, COUNT(*) AS n_events,
               COUNT(DISTINCT CAST(json_extract_string(props, '$.k') AS INT) % 20) AS n_jobs,
               ROUND(CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 4) AS err_ratio
        FROM events GROUP BY 1, 2) r0)
"""

_CAPABILITY = ("CASE source_id % 5 WHEN 1 THEN 'list_only' WHEN 2 THEN 'partial' WHEN 3 THEN 'manual' "
               "WHEN 4 THEN 'pending' ELSE 'full' END")
# what a run without a row says, ``_o`` days from the end of its source's calendar
_SAYS_EMPTY = "CASE WHEN _o = -1 THEN source_id % 3 = 0 WHEN _o IN (1, 3) THEN source_id % 2 = 0 ELSE FALSE END"
_SAYS_WHOLE = "explicit_empty OR source_id % 4 = 1"


def with_zero_runs(runs: DataFrame) -> DataFrame:
    """Runs with their capability, plus runs without a row before and after a source's calendar.

    Some of those state that the list is empty (``explicit_empty``), some merely found
    nothing; a few of the latter even claim to be whole.
    """
    by_day = Window.partitionBy("source_id").orderBy("run_date")
    near = runs.withColumns({"_before": F.lag("run_date").over(by_day), "_after": F.lead("run_date").over(by_day)})
    shifts = F.expr("filter(array(0, -2, -1, 1, 2, 3), o -> o = 0 OR (o < 0 AND _before IS NULL) OR (o > 0 AND _after IS NULL))")
    s = near.withColumn("_o", F.explode(shifts)).withColumn("explicit_empty", F.expr(_SAYS_EMPTY))
    changed = {"run_date": "date_add(run_date, _o)", "n_events": "IF(_o = 0, n_events, 0L)", "n_jobs": "IF(_o = 0, n_jobs, 0L)",
               "err_ratio": "IF(_o = 0, err_ratio, 0D)", "status": "IF(_o = 0, status, 'ok')",
               "listing_complete": f"IF(_o = 0, listing_complete, {_SAYS_WHOLE})"}
    return s.select(*[F.expr(changed.get(c, c)).alias(c) for c in runs.columns], "explicit_empty",
                    F.expr(_CAPABILITY).alias("capability"))


def listed_runs(spark: SparkSession, sf: str) -> DataFrame:
    return with_zero_runs(runs(spark, sf))


LISTED = f"""
listed AS (
  SELECT source_id, run_date, n_events, n_jobs, err_ratio, listing_complete, status, FALSE AS explicit_empty, {_CAPABILITY} AS capability
  FROM runs
  UNION ALL
  SELECT source_id, (CASE WHEN o < 0 THEN lo ELSE hi END) + o, 0, 0, 0.0, said OR source_id % 4 = 1, 'ok', said, {_CAPABILITY}
  FROM (SELECT *, CASE WHEN o = -1 THEN source_id % 3 = 0 WHEN o IN (1, 3) THEN source_id % 2 = 0 ELSE FALSE END AS said
        FROM (SELECT source_id, MIN(run_date) AS lo, MAX(run_date) AS hi FROM runs GROUP BY 1) ends
        CROSS JOIN (VALUES (-2), (-1), (1), (2), (3)) shifts(o)) zero)
"""
# the runs of a stream, which sees only runs with rows
LISTED_ONLY_SEEN = f"""
listed AS (SELECT *, FALSE AS explicit_empty, {_CAPABILITY} AS capability FROM runs)
"""

# accepted: runs after the zero-row and volume-drop rules, stated as a recursion over the runs
ACCEPTED = """
run_seq AS (SELECT *, n_jobs = 0 AND NOT explicit_empty AS unproved, capability IN ('manual', 'pending') AS silent,
                   ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY run_date) AS rn FROM listed),
fold AS (
  SELECT source_id, run_date, rn, listing_complete AND NOT unproved AS accepted, unproved AND NOT silent AS guarded,
         CASE WHEN listing_complete AND NOT unproved THEN n_jobs ELSE 0 END AS last_count
  FROM run_seq WHERE rn = 1
  UNION ALL
  SELECT source_id, run_date, rn, listing_complete AND NOT unproved AND NOT dropped,
         dropped OR (unproved AND NOT silent),
         CASE WHEN listing_complete AND NOT unproved AND NOT dropped THEN n_jobs ELSE last_count END
  FROM (SELECT s.*, f.last_count, f.last_count >= 5 AND NOT s.explicit_empty
                      AND s.n_jobs < f.last_count * CAST(0.4 AS DOUBLE) AS dropped
        FROM fold f JOIN run_seq s ON s.source_id = f.source_id AND s.rn = f.rn + 1) step),
accepted AS (SELECT r.*, f.accepted, f.guarded FROM listed r
             JOIN fold f ON f.source_id = r.source_id AND f.run_date = r.run_date)
"""


def vol_runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(
        F.expr("user_id % 50").alias("source_id"), F.to_date("ts").alias("run_date")).agg(
        F.countDistinct(F.get_json_object("props", "$.k").cast("int")).alias("n_jobs"))


VOL_RUNS = """
vol_runs AS (SELECT user_id % 50 AS source_id, CAST(ts AS DATE) AS run_date,
                    COUNT(DISTINCT CAST(json_extract_string(props, '$.k') AS INT)) AS n_jobs
             FROM events GROUP BY 1, 2)
"""

# ---------------------------------------------------------------------------
# health: every run with a capability and its error texts


def health_runs(spark: SparkSession, sf: str) -> DataFrame:
    return with_errors(listed_runs(spark, sf))


def with_errors(runs: DataFrame) -> DataFrame:
    return runs.select(
        "*", F.expr("CASE WHEN err_ratio > 0.25D THEN array('list not read', 'details failed') "
               "WHEN err_ratio > 0.15D THEN array('details failed') ELSE array() END").alias("errors"),
        F.concat(F.lit("Institution "), F.char(F.lit(74) - F.col("source_id"))).alias("institution"))


HEALTH_OF_LISTED = """
health_runs AS (
  SELECT *, CASE WHEN err_ratio > 0.25 THEN 'details failed|list not read'
              WHEN err_ratio > 0.15 THEN 'details failed' ELSE '' END AS error_set,
         concat('Institution ', chr(CAST(74 - source_id AS INT))) AS institution
  FROM listed)
"""
HEALTH_RUNS = RUNS + "," + LISTED + "," + HEALTH_OF_LISTED

# ---------------------------------------------------------------------------
# ads: advertisement-shaped documents


def ads(spark: SparkSession, sf: str) -> DataFrame:
    return ads_of(table(spark, sf, "documents"))


def ads_of(documents: DataFrame) -> DataFrame:
    return documents.select(
        "doc_id", F.col("source").alias("source_id"), "lang", "text",
        F.expr("substr(sha2(concat(source, char(0), CAST(doc_id AS STRING)), 256), 1, 24)").alias("id"),
        F.expr("substr(replace(text, char(10), ' '), 1, 80)").alias("title"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE date_add(DATE '2024-01-01', CAST(doc_id % 90 AS INT)) END").alias("posted_date"),
        F.expr("timestampadd(HOUR, CAST(doc_id % 2400 AS INT), TIMESTAMP_NTZ '2024-01-01 00:30:00')").alias("first_seen"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'closing' WHEN 1 THEN 'review' WHEN 2 THEN 'until-filled' "
               "WHEN 3 THEN 'closing' ELSE 'unknown' END").alias("deadline_type"),
        F.expr("CASE WHEN doc_id % 5 IN (0, 1, 3) THEN date_add(DATE '2024-01-15', CAST(doc_id % 100 AS INT)) END").alias("deadline"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'part-time' WHEN 1 THEN 'full-time' WHEN 2 THEN 'hourly' ELSE 'unknown' END").alias("employment_type"),
        F.expr("CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 6 = 0 THEN 'closed' ELSE 'open' END").alias("status"),
        F.expr("n_chars >= 100").alias("detail_complete"))


ADS = """
ads AS (
  SELECT doc_id, source AS source_id, lang, text,
         substr(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 24) AS id,
         substr(replace(text, chr(10), ' '), 1, 80) AS title,
         CASE WHEN doc_id % 7 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 90 AS INT) END AS posted_date,
         TIMESTAMP '2024-01-01 00:30:00' + to_hours(CAST(doc_id % 2400 AS INT)) AS first_seen,
         CASE doc_id % 5 WHEN 0 THEN 'closing' WHEN 1 THEN 'review' WHEN 2 THEN 'until-filled'
                         WHEN 3 THEN 'closing' ELSE 'unknown' END AS deadline_type,
         CASE WHEN doc_id % 5 IN (0, 1, 3) THEN DATE '2024-01-15' + CAST(doc_id % 100 AS INT) END AS deadline,
         CASE doc_id % 4 WHEN 0 THEN 'part-time' WHEN 1 THEN 'full-time' WHEN 2 THEN 'hourly' ELSE 'unknown' END AS employment_type,
         CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 6 = 0 THEN 'closed' ELSE 'open' END AS status,
         n_chars >= 100 AS detail_complete
  FROM documents)
"""

# ---------------------------------------------------------------------------
# adverts: documents with advertisement titles and sentences the rules look for

_TITLES = ["Part-time Lecturer in Philosophy", "Research Assistant in Ethics",
           "Adjunct Teaching Faculty (Part time)", "Tutor (Full-time)",
           "Instructor, AI literacy - hourly paid", "Chair in Nursing",
           "兼職講師（通識）", "Teaching Fellow for Part-time Programme",
           "Lecturer, full-time and part–time", "Teachers of Critical Thinking, hourly rate"]
_LINES = ["Applicants should possess a Doctor of Philosophy degree.",
          "The University is committed to equality, ethics and diversity.",
          "Candidates must demonstrate critical thinking skills.",
          "The post holder will teach critical thinking and AI ethics.",
          "Teach general education courses; AI   literacy is an asset.",
          "The chair will advise on AI and humanities.",
          "We are recruiting a part-time lecturer for the core curriculum.",
          "Remuneration is at an hourly rate.\nOur teaching philosophy is simple.",
          "Equal opportunities employer\nEthical conduct is expected.",
          "Nothing further.",
          "Duties include moral  philosophy seminars.\n人工智能素養課程"]
_DEPARTMENTS = ["Humanities", "", "Department of Ethics"]


def _case(column: str, values: list[str], newline: str) -> str:
    arms = " ".join(
        "WHEN {} THEN {}".format(i, "'" + v.replace("\n", f"' || {newline} || '") + "'")
        for i, v in enumerate(values))
    return f"CASE {column} % {len(values)} {arms} END"


def _advert_columns():
    return [F.expr(_case("doc_id", _TITLES, "char(10)")).alias("title"),
            F.expr(_case("doc_id", _DEPARTMENTS, "char(10)")).alias("department"),
            F.expr("text || char(10) || " + _case("doc_id", _LINES, "char(10)")).alias("description")]


def adverts(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"), *_advert_columns())


def search_ads(spark: SparkSession, sf: str) -> DataFrame:
    """Ads with advertisement texts, as the search page sees them."""
    a = ads_of(text_table(spark, sf, "documents"))
    return a.select(*[c for c in a.columns if c not in ("title", "text")], *_advert_columns())


ADVERTS = f"""
adverts AS (
  SELECT doc_id, source AS source_id, {_case("doc_id", _TITLES, "chr(10)")} AS title,
         {_case("doc_id", _DEPARTMENTS, "chr(10)")} AS department,
         text || chr(10) || {_case("doc_id", _LINES, "chr(10)")} AS description
  FROM documents)
"""

# ---------------------------------------------------------------------------
# date_texts: labelled date strings with the date used to make them


def date_texts(spark: SparkSession, sf: str) -> DataFrame:
    y = text_table(spark, sf, "orders").select(
        "o_orderkey", F.expr("date_add(CAST(o_orderdate AS DATE), 9131)").alias("d"))
    f1, f2 = "date_format(d, 'd MMMM yyyy')", "date_format(d, 'MMMM d, yyyy')"
    f3, f4 = "date_format(d, 'yyyy年M月d日')", "date_format(d, 'd-MMM-yyyy')"
    return y.select("o_orderkey", F.col("d").alias("expected"), F.expr(f"""CASE o_orderkey % 8
        WHEN 0 THEN concat('Closing date: ', {f1})
        WHEN 1 THEN concat('Posted on ', {f2})
        WHEN 2 THEN concat('截止日期：', {f3})
        WHEN 3 THEN concat('Closing date: ', {f1}, ' or until filled, whichever is earlier')
        WHEN 4 THEN 'Closing date: until the post is filled'
        WHEN 5 THEN concat('Initial screening: ', {f1})
        WHEN 6 THEN '30+ days ago'
        ELSE concat('Application deadline: ', {f4}) END""").alias("txt"))


DATE_TEXTS = """
date_texts AS (
  SELECT o_orderkey, d AS expected, CASE o_orderkey % 8
    WHEN 0 THEN concat('Closing date: ', strftime(d, '%-d %B %Y'))
    WHEN 1 THEN concat('Posted on ', strftime(d, '%B %-d, %Y'))
    WHEN 2 THEN concat('截止日期：', strftime(d, '%Y年%-m月%-d日'))
    WHEN 3 THEN concat('Closing date: ', strftime(d, '%-d %B %Y'), ' or until filled, whichever is earlier')
    WHEN 4 THEN 'Closing date: until the post is filled'
    WHEN 5 THEN concat('Initial screening: ', strftime(d, '%-d %B %Y'))
    WHEN 6 THEN '30+ days ago'
    ELSE concat('Application deadline: ', strftime(d, '%-d-%b-%Y')) END AS txt
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 9131 AS d FROM orders) y)
"""


def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").alias("page"),
        F.col("l_partkey").alias("ref"), "l_suppkey")
