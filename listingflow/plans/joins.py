"""Joins: reconcile, identity, editions, matching, health, outbox, saved searches."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import fixtures as X
from ..functions import rules
from ..functions.text import clean_text
from ..operators import health, landing, lifecycle, outbox, reconcile, search
from ..operators.search import SavedSearch
from ..registry import query
from ..session import work_path
from ..sources.tables import table
from .common import ACC, CARRY, DENSE, accepted_runs, cte, day, joined, obs_timeline, sql_fold
from .filters import GATE, SQL_BOILERPLATE, SQL_EFFECTIVE, gate_inputs
from .sequences import HEALTH_CTE, STATE, health_state

KEY = ["source_id", "job_key"]


def landed_obs(spark, sf):
    """Observations landed by day, and the newest day, which is the batch."""
    rows = landing.land(X.obs(spark, sf), work_path(spark, "observations"), "run_date", "source_id", "job_key")
    return rows, landing.newest_day(rows, "run_date")


def last_day_split(rows, at):
    """State before the batch day, and that day's batch."""
    earlier, batch = landing.split_at(rows, "run_date", at)
    return reconcile.latest_state(earlier, KEY, F.col("run_date")), batch


SPLIT = """
lastday AS (SELECT MAX(run_date) AS d FROM obs),
batch AS (SELECT * FROM obs WHERE run_date = (SELECT d FROM lastday)),
old AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id, job_key ORDER BY run_date DESC) AS rn
        FROM obs WHERE run_date < (SELECT d FROM lastday)) x WHERE rn = 1)
"""


@query("reconcile_upsert", cte(X.OBS, SPLIT) + """
SELECT COALESCE(o.source_id, b.source_id) AS source_id, COALESCE(o.job_key, b.job_key) AS job_key,
       CASE WHEN o.job_key IS NULL THEN 'insert' WHEN b.job_key IS NULL THEN 'absent'
            WHEN o.title = b.title AND o.department = b.department THEN 'keep' ELSE 'update' END AS action,
       COALESCE(b.title, o.title) AS title, COALESCE(b.department, o.department) AS department
FROM old o FULL OUTER JOIN batch b ON b.source_id = o.source_id AND b.job_key = o.job_key""")
def reconcile_upsert(spark, sf):
    state, batch = last_day_split(*landed_obs(spark, sf))
    return reconcile.upsert(state, batch, KEY, ["title", "department"])


@query("absent_from_batch", cte(*ACC, SPLIT) + """
SELECT o.source_id, o.job_key, CAST(o.run_date AS VARCHAR) AS last_seen FROM old o
WHERE EXISTS (SELECT 1 FROM accepted a WHERE a.source_id = o.source_id AND a.accepted AND a.run_date = (SELECT d FROM lastday))
  AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.source_id = o.source_id AND b.job_key = o.job_key)""")
def absent_from_batch(spark, sf):
    rows, at = landed_obs(spark, sf)
    state, batch = last_day_split(rows, at)
    runs = accepted_runs(spark, sf).where(F.col("run_date") == F.lit(at))
    return reconcile.absent_from_batch(state, batch, runs, KEY).select(*KEY, day("run_date").alias("last_seen"))


@query("source_known", """
WITH e AS (SELECT user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS source_id, CAST(ts AS DATE) AS d FROM events),
l AS (SELECT MAX(d) AS d FROM e)
SELECT source_id, COUNT(*) AS n_rows FROM e WHERE d = (SELECT d FROM l)
  AND source_id IN (SELECT source_id FROM e WHERE d < (SELECT d FROM l)) GROUP BY 1""")
def source_known(spark, sf):
    e = table(spark, sf, "events").select(
        F.expr("user_id * 100 + CAST(get_json_object(props, '$.k') AS BIGINT)").alias("source_id"), F.to_date("ts").alias("d"))
    rows = landing.land(e.groupBy("source_id", "d").agg(F.count("*").alias("n_rows")), work_path(spark, "sources"), "d", "source_id")
    earlier, batch = landing.split_at(rows, "d", landing.newest_day(rows, "d"))
    # Any earlier record makes a source known.
    return batch.select("source_id", "n_rows").join(earlier.select("source_id").distinct(), "source_id", "left_semi")


@query("listing_detail_identity", """
WITH d AS (SELECT l_orderkey AS fetched, l_linenumber AS line,
                  CASE WHEN l_partkey % 13 = 0 THEN 'Ref ' || (l_orderkey + 1) WHEN l_partkey % 13 = 1 THEN ' r e f ' || l_orderkey || ' (new)'
                       ELSE 'Ref ' || l_orderkey END AS detail_ref FROM lineitem)
SELECT o.o_orderkey AS listing_id, d.line, d.detail_ref,
       CASE WHEN d.fetched IS NULL THEN 'no detail' WHEN d.detail_ref = 'Ref ' || o.o_orderkey THEN 'same'
            WHEN contains(lower(replace(d.detail_ref, ' ', '')), 'ref' || o.o_orderkey) THEN 'contained' ELSE 'rejected' END AS identity
FROM orders o LEFT JOIN d ON d.fetched = o.o_orderkey""")
def listing_detail_identity(spark, sf):
    listing = table(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id"),
                                                F.concat(F.lit("Ref "), "o_orderkey").alias("reference"))
    d = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("listing_id"), F.col("l_linenumber").alias("line"),
        F.expr("CASE WHEN l_partkey % 13 = 0 THEN 'Ref ' || (l_orderkey + 1) WHEN l_partkey % 13 = 1 "
               "THEN ' r e f ' || l_orderkey || ' (new)' ELSE 'Ref ' || l_orderkey END").alias("detail_ref"))
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    identity = (F.when(F.col("detail_ref").isNull(), "no detail").when(F.col("detail_ref") == F.col("reference"), "same")
                .when(squeeze(F.col("detail_ref")).contains(squeeze(F.col("reference"))), "contained").otherwise("rejected"))
    return listing.join(d, "listing_id", "left").select("listing_id", "line", "detail_ref", identity.alias("identity"))


#: What a parallel edition fills, beside the mark that the detail is complete.
EDITION_FIELDS = ["description", "match_text", "posted_date", "deadline", "deadline_type", "deadline_raw"]


@query("language_coalesce", cte(X.ADS, """
e AS (SELECT doc_id // 2 AS ref, doc_id % 2 AS side, title, text AS description, 'm' || doc_id AS match_text, posted_date, deadline, deadline_type,
        CASE WHEN deadline IS NOT NULL THEN 'until ' || doc_id END AS deadline_raw, length(text) >= 1000 AS detail_complete FROM ads),
j AS (SELECT m.*, o.description AS o_description, o.match_text AS o_match, o.posted_date AS o_posted, o.deadline AS o_deadline, o.deadline_type AS o_type,
        o.deadline_raw AS o_raw, COALESCE(o.detail_complete, FALSE) AS o_complete, NOT m.detail_complete AND COALESCE(o.detail_complete, FALSE) AS filled
      FROM (SELECT * FROM e WHERE side = 0) m LEFT JOIN (SELECT * FROM e WHERE side = 1) o ON o.ref = m.ref)""") + """
SELECT ref, title, filled, CASE WHEN filled THEN o_description ELSE description END AS description, CASE WHEN filled THEN o_match ELSE match_text END AS match_text,
  CAST(CASE WHEN filled THEN o_posted ELSE posted_date END AS VARCHAR) AS posted_date,
  CAST(CASE WHEN filled THEN o_deadline ELSE deadline END AS VARCHAR) AS deadline, CASE WHEN filled THEN o_type ELSE deadline_type END AS deadline_type,
  CASE WHEN filled THEN o_raw ELSE deadline_raw END AS deadline_raw, detail_complete OR o_complete AS detail_complete FROM j""")
def language_coalesce(spark, sf):
    e = X.ads(spark, sf).select(
        F.expr("doc_id DIV 2").alias("ref"), F.expr("doc_id % 2").alias("side"), "title", F.col("text").alias("description"),
        F.concat(F.lit("m"), "doc_id").alias("match_text"), "posted_date", "deadline", "deadline_type",
        F.when(F.col("deadline").isNotNull(), F.concat(F.lit("until "), "doc_id")).alias("deadline_raw"),
        (F.length("text") >= 1000).alias("detail_complete"))
    rows = reconcile.fill_from_edition(e.filter("side = 0").drop("side"), e.filter("side = 1").drop("side", "title"), "ref", EDITION_FIELDS)
    return rows.withColumns({c: day(c) for c in ("posted_date", "deadline")})


# --- matching ---------------------------------------------------------------

def _test(text: str, term: str) -> str:
    term = term.lower()
    if not term.isascii():
        return f"contains({text}, '{term}')"
    return f"(contains({text}, '{term}') AND regexp_matches({text}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)'))"


def _found(terms: list[str]) -> str:
    arms = ", ".join(f"CASE WHEN {_test('f', t)} THEN '{t}' END" for t in terms)
    return f"array_to_string(list_filter([{arms}], lambda x: x IS NOT NULL), '|')"


_PER_SUBJECT = " UNION ALL ".join(
    f"SELECT doc_id, '{sid}' AS subject, {weight} AS weight, {_found(terms)} AS terms FROM folded"
    for sid, _, weight, terms in V.SUBJECTS)
_LINES_HIT = " UNION ALL ".join(
    "SELECT doc_id, '{}' AS subject, line, pos FROM lf WHERE {}".format(sid, " OR ".join(_test("f", t) for t in terms))
    for sid, _, _, terms in V.SUBJECTS)
MATCH = f"""
body AS MATERIALIZED (SELECT doc_id, source_id, title, department, title || chr(10) || department || chr(10) || {SQL_BOILERPLATE.format('description')} AS txt FROM adverts),
folded AS MATERIALIZED (SELECT doc_id, {sql_fold('txt')} AS f FROM body),
per AS (SELECT * FROM ({_PER_SUBJECT}) x WHERE terms <> ''),
roles AS (SELECT doc_id, source_id, CASE doc_id % 10 WHEN 1 THEN 'other' WHEN 3 THEN 'tutor' WHEN 4 THEN 'instructor' WHEN 5 THEN 'other' ELSE 'lecturer' END AS role,
     CASE doc_id % 10 WHEN 0 THEN 'part-time' WHEN 2 THEN 'part-time' WHEN 3 THEN 'full-time' WHEN 4 THEN 'hourly' WHEN 6 THEN 'part-time'
       WHEN 8 THEN 'mixed' WHEN 9 THEN 'hourly' ELSE CASE doc_id % 11 WHEN 6 THEN 'part-time' WHEN 7 THEN 'hourly' ELSE 'unknown' END END AS employment
     FROM adverts)
"""


def evaluated(spark, sf):
    text = rules.subject_text(F.col("title"), F.col("department"), F.lit(""), F.col("description"))
    return rules.with_subject_hits(X.adverts(spark, sf), text)


def hit_rows(spark, sf):
    """One row per (record, subject).  The outer form keeps Spark from deriving a
    "has elements" filter, which it would push below the normalising projections and so
    repeat the whole matching."""
    return evaluated(spark, sf).select("doc_id", F.inline_outer("hits")).filter("subject IS NOT NULL")


@query("subject_match", cte(X.ADVERTS, MATCH) + "SELECT doc_id, subject, weight, terms FROM per")
def subject_match(spark, sf):
    return hit_rows(spark, sf).select("doc_id", "subject", "weight", joined(F.col("terms")).alias("terms"))


@query("evidence_line", cte(X.ADVERTS, MATCH, f"""
ln AS (SELECT doc_id, string_split(txt, chr(10)) AS ls FROM body),
lu AS (SELECT doc_id, ls, unnest(range(len(ls))) AS pos FROM ln),
lf AS MATERIALIZED (SELECT doc_id, pos, trim(ls[pos + 1]) AS line, {sql_fold('ls[pos + 1]')} AS f FROM lu),
ev AS (SELECT doc_id, subject, arg_min(line, pos) AS line FROM ({_LINES_HIT}) h GROUP BY 1, 2)""") + """
SELECT doc_id, subject, substr(line, 1, 300) AS snippet FROM ev""")
def evidence_line(spark, sf):
    return hit_rows(spark, sf).select("doc_id", "subject", "snippet")


SCORE_SQL = """
sc AS (SELECT r.doc_id, r.role, r.employment, r.source_id, COALESCE(MAX(p.weight), 0) AS top, COUNT(p.subject) AS n
       FROM roles r LEFT JOIN per p ON p.doc_id = r.doc_id GROUP BY 1, 2, 3, 4),
scored AS (SELECT *, CASE WHEN n > 0 AND employment IN ('part-time', 'hourly', 'mixed') AND role <> 'other' THEN LEAST(100, top + 20) ELSE LEAST(top, 50) END AS score FROM sc)
"""


def scored(spark, sf):
    e = rules.with_employment(evaluated(spark, sf), F.col("title"), None, F.col("description"))
    e = e.withColumn("employment", F.col("employment_type")).withColumn("role", rules.role_of(F.col("title")))
    return e.withColumn("score", rules.score_of(F.col("hits"), F.col("role"), F.col("employment"))).withColumn(
        "matches", rules.is_match(F.col("hits"), F.col("score"), F.col("role"), F.col("employment"), F.col("source_id"),
                                  F.concat_ws(" ", "title", "department", "description"), exclude=["seminars"]))


@query("score_max", cte(X.ADVERTS, MATCH, SCORE_SQL) + """
SELECT s.doc_id, s.role, s.employment, s.n AS n_subjects, s.score,
       n > 0 AND score >= 60 AND role <> 'other' AND employment IN ('part-time', 'hourly', 'mixed') AND s.doc_id % 11 <> 10 AS matches FROM scored s""")
def score_max(spark, sf):
    return scored(spark, sf).select("doc_id", "role", "employment", F.size("hits").cast("bigint").alias("n_subjects"),
                                    "score", "matches")


@query("published_decision", cte(X.ADS, X.ADVERTS, MATCH, SCORE_SQL) + """
SELECT s.doc_id, m.matches, m.matches AND (a.detail_complete OR s.doc_id % 3 <> 0) AS published
FROM scored s JOIN ads a ON a.doc_id = s.doc_id
JOIN (SELECT doc_id, n > 0 AND score >= 60 AND role <> 'other' AND employment IN ('part-time', 'hourly', 'mixed') AND doc_id % 11 <> 10 AS matches FROM scored) m ON m.doc_id = s.doc_id""")
def published_decision(spark, sf):
    """Stored records judged again under the rules of today; one without detail and body is never published as a match."""
    known = X.ads(spark, sf).select("doc_id", "detail_complete")
    rows = scored(spark, sf).select("doc_id", "matches", F.when(F.col("doc_id") % 3 != 0, F.col("description")).alias("body")).join(known, "doc_id")
    return rows.select("doc_id", "matches", rules.published_match(F.col("matches"), F.col("detail_complete"), F.col("body")).alias("published"))


# --- health and outbox joins -------------------------------------------------

@query("source_health_join", cte(*HEALTH_CTE, """
dim AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, n_name AS name, n_nationkey % 6 <> 5 AS enabled,
               CASE WHEN n_nationkey % 7 = 3 THEN 'pending' ELSE 'full' END AS configured FROM nation),
cur AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY run_date DESC) AS rn FROM health) x WHERE rn = 1),
j AS (SELECT d.source_id, d.name, d.enabled, COALESCE(c.status, CASE WHEN d.enabled THEN 'unverified' ELSE 'pending' END) AS st,
             CASE WHEN d.source_id % 3 = 0 THEN d.configured ELSE COALESCE(c.capability, d.configured) END AS capability,
             CASE WHEN d.source_id % 3 <> 0 THEN c.accepted END AS lc, CASE WHEN d.source_id % 3 <> 0 THEN c.severity END AS sv,
             COALESCE(c.n_jobs, 0) AS n_jobs FROM dim d LEFT JOIN cur c ON c.source_id = d.source_id)""") + """
SELECT source_id, name, CASE WHEN enabled THEN st ELSE 'pending' END AS status, capability, COALESCE(lc, st = 'ok') AS listing_complete,
       COALESCE(sv, CASE WHEN st = 'ok' THEN 'ok' WHEN capability IN ('manual', 'pending') THEN 'warning' ELSE 'error' END) AS severity,
       n_jobs FROM j""")
def source_health_join(spark, sf):
    dim = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("source_id"), F.col("n_name").alias("name"),
        F.expr("n_nationkey % 6 <> 5").alias("enabled"),
        F.expr("CASE WHEN n_nationkey % 7 = 3 THEN 'pending' ELSE 'full' END").alias("configured"))
    old_row = F.col("source_id") % 3 == 0     # rows written before these columns existed
    cur = reconcile.latest_state(health_state(spark, sf).select(
        "source_id", "run_date", "status", "n_jobs", F.when(~old_row, F.col("accepted")).alias("listing_complete"),
        F.when(~old_row, F.col("severity")).alias("severity"),
        F.when(~old_row, F.col("capability")).alias("capability")), ["source_id"], F.col("run_date"))
    st = F.coalesce("status", F.when(F.col("enabled"), "unverified").otherwise("pending"))
    cap = F.coalesce("capability", "configured")
    return dim.join(cur, "source_id", "left").select(
        "source_id", "name", F.when(F.col("enabled"), st).otherwise("pending").alias("status"), cap.alias("capability"),
        F.coalesce("listing_complete", st == "ok").alias("listing_complete"),
        F.coalesce("severity", F.when(st == "ok", "ok").when(cap.isin(*V.SILENT_CAPABILITIES), "warning").otherwise("error")).alias("severity"),
        F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"))


@query("outbox_jobs_join", cte(*ACC, CARRY, DENSE, STATE) + """
SELECT 'new:' || source_id || '-' || job_key AS event_id, first_seen AS created_at,
       CASE WHEN source_id = 3 AND job_key = 5 THEN '' ELSE status END AS status,
       CASE WHEN source_id = 3 AND job_key = 5 THEN '' ELSE last_seen END AS last_seen FROM state""")
def outbox_jobs_join(spark, sf):
    events, jobs = gate_inputs(spark, sf)
    return events.join(jobs.select("id", "status", day("last_seen").alias("last_seen")), "id", "left").select(
        "event_id", day("created_at").alias("created_at"), F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("last_seen", F.lit("")).alias("last_seen"))


@query("digest_ack", cte(*HEALTH_CTE, """
o AS (SELECT event_id, created_at, CASE WHEN change = 'changed' THEN 'superseded' ELSE 'pending' END AS state FROM trans)""") + """
SELECT event_id, CASE WHEN state = 'pending' AND created_at <= DATE '2024-01-20' THEN 'sent' ELSE state END AS state,
       CASE WHEN state = 'pending' AND created_at <= DATE '2024-01-20' THEN 'health-digest:' || CAST(created_at AS VARCHAR) ELSE '' END AS summary_id FROM o""")
def digest_ack(spark, sf):
    events = health.transitions(health_state(spark, sf))
    held = events.select("event_id", F.when(F.col("change") == "changed", "superseded").otherwise("pending").alias("state"))
    # One array per digest: at most one transition per source and day.
    acked = events.filter("created_at <= DATE '2024-01-20'").groupBy("created_at").agg(
        F.collect_list("event_id").alias("events")).select(
        F.concat(F.lit("health-digest:"), day("created_at")).alias("summary_id"), "events")
    return outbox.acknowledge(held, acked).select("event_id", "state", F.coalesce("summary_id", F.lit("")).alias("summary_id"))


@query("digest_attempts", cte(*HEALTH_CTE, """
days AS (SELECT DISTINCT run_date AS day FROM health),
attempts AS (SELECT datediff('day', DATE '2024-01-01', day) * 2 + slot AS attempt, day, day - 1 + slot AS as_of,
               CASE WHEN slot = 0 THEN datediff('day', DATE '2024-01-01', day) % 3 <> 0 ELSE datediff('day', DATE '2024-01-01', day) % 2 = 0 END AS acked
             FROM days CROSS JOIN (VALUES (0), (1)) s(slot)),
state_at AS (SELECT a.attempt, h.source_id, arg_max(h.status, h.run_date) AS status FROM attempts a JOIN health h ON h.run_date <= a.as_of GROUP BY 1, 2),
event_at AS (SELECT a.attempt, t.source_id, arg_max(t.event_id, t.created_at) AS event_id, MAX(t.created_at) AS created_at, arg_max(t.change, t.created_at) AS change
             FROM attempts a JOIN trans t ON t.created_at <= a.as_of GROUP BY 1, 2),
pend AS (SELECT e.*, s.status FROM event_at e JOIN state_at s ON s.attempt = e.attempt AND s.source_id = e.source_id
         WHERE NOT EXISTS (SELECT 1 FROM attempts j WHERE j.attempt < e.attempt AND j.acked AND j.as_of >= e.created_at)
           AND NOT (s.status = 'ok' AND e.change <> 'recovered')),
per AS (SELECT a.*, (SELECT COUNT(*) FROM state_at s WHERE s.attempt = a.attempt AND s.status <> 'ok') AS n_all,
               (SELECT COUNT(*) FROM pend p WHERE p.attempt = a.attempt AND p.status <> 'ok') AS n_changed,
               (SELECT COUNT(*) FROM pend p WHERE p.attempt = a.attempt AND p.change = 'recovered') AS n_recoveries,
               (SELECT string_agg(p.event_id, '|' ORDER BY p.event_id) FROM pend p WHERE p.attempt = a.attempt) AS events FROM attempts a),
said AS (SELECT p.*, EXISTS (SELECT 1 FROM per j WHERE j.day = p.day AND j.attempt < p.attempt AND j.acked AND (j.n_all > 0 OR j.n_recoveries > 0)) AS daily_sent FROM per p),
made AS (SELECT *, CASE WHEN daily_sent THEN 'health-changes:' || substr(sha256(events), 1, 20) ELSE 'health-digest:' || CAST(day AS VARCHAR) END AS summary_id
         FROM said WHERE (n_all > 0 OR n_recoveries > 0) AND NOT (daily_sent AND events IS NULL))""") + """
SELECT attempt, CAST(day AS VARCHAR) AS day, summary_id, CASE WHEN daily_sent THEN 'health_changes' ELSE 'health_digest' END AS kind,
  CASE WHEN daily_sent THEN n_changed ELSE n_all END AS n_problems, n_recoveries, COALESCE(events, '') AS events,
  CASE WHEN acked THEN 'sent' WHEN EXISTS (SELECT 1 FROM made j WHERE j.summary_id = m.summary_id AND j.attempt > m.attempt) THEN 'replaced'
       WHEN attempt < (SELECT MAX(attempt) FROM attempts) THEN 'superseded' ELSE 'pending' END AS outcome FROM made m""")
def digest_attempts(spark, sf):
    """Two delivery attempts a day, before and after the day's run; some are acknowledged."""
    h = health_state(spark, sf)
    nth = F.datediff("day", F.lit("2024-01-01").cast("date"))
    attempts = h.select(F.col("run_date").alias("day")).distinct().withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (nth * 2 + F.col("slot")).cast("bigint").alias("attempt"), "day", F.date_add(F.date_sub("day", 1), F.col("slot")).alias("as_of"),
        F.when(F.col("slot") == 0, nth % 3 != 0).otherwise(nth % 2 == 0).alias("acked"))
    return health.digests(h, health.transitions(h), attempts).withColumn("day", day("day")).withColumn("events", joined(F.col("events")))


# --- saved searches ------------------------------------------------------------

SEARCHES = [
    SavedSearch("and", recent_days="all", query="philosophy lecturer"),
    SavedSearch("or", recent_days="30", query='tutor, "AI literacy" -hourly', mode="OR"),
    SavedSearch("preset", recent_days="all", preset_enabled=True, subject_keywords="philosophy, critical thinking",
                role_keywords="lecturer, instructor", part_time_only=True),
    SavedSearch("nobody", recent_days="all", institutions=()),
    SavedSearch("dated", recent_days="all", institutions=("src1", "src2", "src3"), status="open", date_basis="deadline",
                date_from="2024-02-01", exclude='"general education"'),
    SavedSearch("without", recent_days="all", preset_enabled=True, role_keywords="teacher\ntutor",
                preset_exclude="通識，AI and humanities"),
]


_WORDS = ["philosophy", "tutor", "ethics", "lecturer", "literacy"]


def nation_searches(spark, sf):
    """A saved search of every nation: two words (all or any), some with bounds or an exclusion."""
    def word(n):
        return F.element_at(F.array(*map(F.lit, _WORDS)), (F.pmod(n, F.lit(len(_WORDS))) + 1).cast("int"))

    n = F.col("n_nationkey")
    none = F.lit("")
    return table(spark, sf, "nation").select(
        F.concat(F.lit("nation-"), n).alias("name"),
        F.when(n % 6 == 0, F.array(F.lit("src1"), F.lit("src2"))).alias("institutions"), F.lit("all").alias("status"),
        F.lit("effective").alias("date_basis"), F.when(n % 4 == 0, "30").otherwise("all").alias("recent_days"),
        none.alias("date_from"), none.alias("date_to"), F.when(n % 2 == 0, "OR").otherwise("AND").alias("mode"),
        F.concat_ws(" ", word(n), word(n + 1 + n % 3)).alias("query"), F.when(n % 3 == 0, "hourly").otherwise("").alias("exclude"),
        F.lit(False).alias("preset_enabled"), none.alias("subject_keywords"), none.alias("role_keywords"),
        none.alias("preset_exclude"), F.lit(False).alias("part_time_only"))


def _has(text: str, *terms: str) -> str:
    return "regexp_matches({}, '(^|[^a-z0-9])({})s?([^a-z0-9]|$)')".format(text, "|".join(terms))


@query("saved_search_match", cte(X.ADS, X.ADVERTS, f"""
s0 AS (SELECT a.id, a.status, a.source_id, a.employment_type, a.deadline_type, a.deadline, {SQL_EFFECTIVE} AS eff, v.title, v.department, v.description
       FROM ads a JOIN adverts v ON v.doc_id = a.doc_id),
s AS (SELECT *, {sql_fold("title || chr(10) || department || chr(10) || employment_type || chr(10) || description")} AS f,
             {sql_fold("title || chr(10) || department || chr(10) || " + SQL_BOILERPLATE.format('description'))} AS fs,
             {sql_fold('title')} AS ft FROM s0),
words AS (SELECT {_WORDS} AS w),
n AS (SELECT n_nationkey AS k, w[n_nationkey % 5 + 1] AS a, w[(n_nationkey + 1 + n_nationkey % 3) % 5 + 1] AS b FROM nation, words),
x AS (SELECT id, f, source_id, eff, {", ".join(_has('f', t) + f" AS has_{t}" for t in _WORDS)}, {_has('f', 'hourly')} AS has_hourly FROM s),
y AS (SELECT *, list_filter(list_transform({_WORDS}, lambda t, i: CASE WHEN [{", ".join("has_" + t for t in _WORDS)}][i] THEN t END),
             lambda t: t IS NOT NULL) AS held FROM x)""") + f"""
SELECT 'nation-' || k AS search, id FROM n JOIN y ON (CASE WHEN k % 2 = 0 THEN list_contains(held, a) OR list_contains(held, b)
       ELSE list_contains(held, a) AND list_contains(held, b) END)
WHERE (k % 6 <> 0 OR source_id IN ('src1', 'src2')) AND (k % 4 <> 0 OR eff BETWEEN DATE '2024-03-20' - 29 AND DATE '2024-03-20')
  AND (k % 3 <> 0 OR NOT has_hourly)
UNION ALL
SELECT 'and' AS search, id FROM s WHERE {_has('f', 'philosophy')} AND {_has('f', 'lecturer')}
UNION ALL SELECT 'or', id FROM s WHERE eff BETWEEN DATE '2024-03-20' - 29 AND DATE '2024-03-20'
  AND ({_has('f', 'tutor')} OR {_has('f', 'ai literacy')}) AND NOT {_has('f', 'hourly')}
UNION ALL SELECT 'preset', id FROM s WHERE {_has('fs', 'philosophy', 'critical thinking')} AND {_has('ft', 'lecturer', 'instructor')}
  AND employment_type IN ('part-time', 'hourly', 'mixed')
UNION ALL SELECT 'dated', id FROM s WHERE source_id IN ('src1', 'src2', 'src3') AND status = 'open' AND deadline_type = 'closing'
  AND deadline >= DATE '2024-02-01' AND NOT {_has('f', 'general education')}
UNION ALL SELECT 'without', id FROM s WHERE {_has('ft', 'teacher', 'tutor')} AND NOT contains(f, '通識') AND NOT {_has('f', 'ai and humanities')}""")
def saved_search_match(spark, sf):
    ads = X.search_ads(spark, sf)
    searches = search.searches_table(spark, SEARCHES).unionByName(nation_searches(spark, sf))
    return search.match_saved_searches(ads, searches, F.lit("2024-03-20").cast("date")).select("search", "id")


@query("known_ads_fallback", cte(*ACC, CARRY, DENSE, STATE) + """
SELECT s.source_id, s.job_key, s.status, FALSE AS listing_complete FROM state s
JOIN (SELECT source_id, arg_max(accepted, run_date) AS ok FROM accepted GROUP BY 1) r ON r.source_id = s.source_id AND NOT r.ok
WHERE s.status <> 'missing' AND s.job_key % 4 <> 0""")
def known_ads_fallback(spark, sf):
    state = lifecycle.current_state(obs_timeline(spark, sf)).withColumn(
        "host", F.when(F.col("job_key") % 4 == 0, "new.example").otherwise("old.example"))
    newest = reconcile.latest_state(accepted_runs(spark, sf).select("source_id", "run_date", "accepted"),
                                    ["source_id"], F.col("run_date"))
    # Re-read known records only; such a batch can never prove that others are gone.
    return state.join(newest.filter("NOT accepted"), "source_id", "left_semi").filter(
        (F.col("status") != "missing") & (F.col("host") == "old.example")).select(
        "source_id", "job_key", "status", F.lit(False).alias("listing_complete"))
