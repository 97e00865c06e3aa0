"""Filters and predicates."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import fixed_values as V
from .. import fixtures as X
from ..functions import rules
from ..functions.keys import url_host, url_part, url_port
from ..functions.rules import without_boilerplate
from ..operators import lifecycle, outbox, reconcile, robots, search
from ..registry import query
from ..sources.tables import table
from .common import ACC, CARRY, DENSE, cte, day, obs_timeline
from .sequences import HEALTH_CTE, STATE, health_state


def allowed_urls(urls, hosts, source: str = "source_id"):
    """https on an allowed host of the URL's source, no userinfo, port 443 or an allowed one.

    ``hosts``: (source_id, host, ports array).  A plain equi-join on the exact host:
    Spark's own size check decides whether the dimension is broadcast.
    """
    netloc = url_part(F.col("url"), "netloc")
    u = urls.withColumn("host", url_host(F.col("url"))).withColumn("port", url_port(F.col("url")))
    j = u.join(hosts.withColumn("known", F.lit(True)), [source, "host"], "left")
    port_ok = F.col("port").isNull() | (F.col("port") == 443) | F.coalesce(F.array_contains("ports", F.col("port")), F.lit(False))
    return j.withColumn("allowed", (F.lower(url_part(F.col("url"), "scheme")) == "https")
                        & F.coalesce("known", F.lit(False)) & ~netloc.contains("@") & port_ok)


_URL = """CASE page_id % 9 WHEN 0 THEN replace(url, '://', '://user@') WHEN 1 THEN regexp_replace(url, '^([a-z]+://[^/]+)', '{g}1:8044')
          WHEN 2 THEN regexp_replace(url, '^([a-z]+://[^/]+)', '{g}1:443') WHEN 3 THEN regexp_replace(url, '^([a-z]+://[^/]+)', '{g}1:9000') ELSE url END"""


@query("url_allowlist", f"""
WITH p AS (SELECT page_id, regexp_extract(url, '(com|net|org)[/?#]', 1) AS source_id, regexp_extract(url, '://([^/?#]+)', 1) AS host,
                  {_URL.format(g=chr(92))} AS url FROM pages),
h AS (SELECT source_id, host FROM p GROUP BY 1, 2 HAVING COUNT(*) >= 2)
SELECT page_id, p.url, regexp_matches(p.url, '^https://') AND h.host IS NOT NULL AND page_id % 9 <> 0
       AND (page_id % 9 <> 3) AND (page_id % 9 <> 1 OR p.source_id = 'com') AS allowed
FROM p LEFT JOIN h ON h.source_id = p.source_id AND h.host = p.host""")
def url_allowlist(spark, sf):
    p = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "(com|net|org)[/?#]", 1).alias("source_id"),
        url_host(F.col("url")).alias("plain_host"), F.expr(_URL.format(g="$")).alias("url"))
    hosts = p.groupBy("source_id", F.col("plain_host").alias("host")).count().filter("count >= 2").select(
        "source_id", "host", F.when(F.col("source_id") == "com", F.array(F.lit(8044))).otherwise(
            F.array().cast("array<int>")).alias("ports"))
    return allowed_urls(p, hosts).select("page_id", "url", "allowed")


ROBOT_RULES = [  # site, agent, allow, pattern: the landed rule lines of three sites
    ("example.com", "*", False, "/"), ("example.com", "listing", False, "/fr/"), ("example.com", "listing", True, "/fr/*.html$"),
    ("example.com", "Listing", False, "/*?page="), ("example.com", "otherbot", False, "/"),
    ("example.net", "*", False, "/en/"), ("example.net", "*", True, "/en/"), ("example.net", "*", False, "/de/*/$"),
    ("example.net", "*", False, "/es/5"), ("example.net", "*", True, "/es/53"),
    ("example.org", "*", False, "/*utm_source"), ("example.org", "*", False, ""), ("example.org", "*", True, "/es/%34"),
    ("example.org", "*", False, "/es/")]


@query("robots_filter", """
WITH p AS (SELECT page_id, url, regexp_extract(url, '(example\\.[a-z]+)', 1) AS site,
                  regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM pages),
r(site, allow, len, re) AS (VALUES
  ('example.com', FALSE, 4, '^/fr/'), ('example.com', TRUE, 9, '^/fr/.*\\.html$'), ('example.com', FALSE, 7, '^/.*\\?page='),
  ('example.net', FALSE, 4, '^/en/'), ('example.net', TRUE, 4, '^/en/'), ('example.net', FALSE, 5, '^/de/.*/$'),
  ('example.net', FALSE, 5, '^/es/5'), ('example.net', TRUE, 6, '^/es/53'),
  ('example.org', FALSE, 11, '^/.*utm_source'), ('example.org', TRUE, 5, '^/es/4'), ('example.org', FALSE, 4, '^/es/')),
m AS (SELECT p.page_id, r.allow, ROW_NUMBER() OVER (PARTITION BY p.page_id ORDER BY len DESC, allow DESC) AS rn
      FROM p JOIN r ON r.site = p.site AND regexp_matches(p.path, r.re))
SELECT p.page_id, p.url, COALESCE(m.allow, TRUE) AS allowed FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.rn = 1""")
def robots_filter(spark, sf):
    rules = spark.createDataFrame(ROBOT_RULES, "site string, agent string, allow boolean, pattern string")
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", r"(example\.[a-z]+)", 1).alias("site"))
    return robots.can_fetch(p, rules, "ListingFlow").select("page_id", "url", "allowed")


@query("min_text_gate", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CASE WHEN length(text) < 100 THEN 'shorter than 100' WHEN length(text) < 200 AND lang = 'de'
       THEN 'shorter than 200' ELSE '' END AS reason FROM documents""")
def min_text_gate(spark, sf):
    n = F.length("text")
    least = F.when(F.col("lang") == "de", 200).otherwise(100)
    return table(spark, sf, "documents").select(
        "doc_id", n.cast("bigint").alias("n"),
        F.when(n < 100, "shorter than 100").when(n < least, "shorter than 200").otherwise("").alias("reason"))


_KEEP = "NOT regexp_matches(x, 'equal opportunit|committed to equality|code of conduct|ethical conduct|professional integrity', 'i')"
_STRIP = "regexp_replace(x, '(?i)(doctor|master) of philosophy|teaching philosophy|personal philosophy', '', 'g')"
SQL_BOILERPLATE = f"""array_to_string(list_transform(list_transform(list_filter(string_split({{0}}, chr(10)), lambda x: {_KEEP}),
    lambda x: {_STRIP}), lambda x: CASE WHEN regexp_matches(x, '(applicants?|candidates?).{{{{0,90}}}}(possess|have|demonstrate)', 'i')
      AND NOT regexp_matches(x, 'teach|course|curriculum', 'i') THEN regexp_replace(x, '(?i)critical thinking|批判思考|批判性思維', '', 'g') ELSE x END), chr(10))"""


@query("boilerplate_lines", cte(X.ADVERTS) + f"""
SELECT doc_id, {SQL_BOILERPLATE.format('description')} AS text FROM adverts""")
def boilerplate_lines(spark, sf):
    return X.adverts(spark, sf).select("doc_id", without_boilerplate(F.col("description")).alias("text"))


SQL_EFFECTIVE = "COALESCE(posted_date, CAST(first_seen + INTERVAL 8 HOUR AS DATE))"


@query("recent_window", cte(X.ADS) + f"""
SELECT id, w.label, CAST({SQL_EFFECTIVE} AS VARCHAR) AS effective_date FROM ads
JOIN (VALUES ('3', 3), ('7', 7), ('14', 14), ('30', 30), ('all', 1000000)) w(label, n)
  ON w.label = 'all' OR {SQL_EFFECTIVE} BETWEEN DATE '2024-03-10' - (w.n - 1) AND DATE '2024-03-10'""")
def recent_window(spark, sf):
    d, today = search.effective_date(), F.lit("2024-03-10").cast("date")
    windows = [("3", 3), ("7", 7), ("14", 14), ("30", 30), ("all", None)]
    labels = F.array_compact(F.array(*[
        F.when(search.in_recent_window(d, today, n), F.lit(label)) for label, n in windows]))
    return X.ads(spark, sf).select("id", F.explode(labels).alias("label"), day(d).alias("effective_date"))


@query("date_basis_filter", cte(X.ADS) + f"""
SELECT id, {SQL_EFFECTIVE} BETWEEN DATE '2024-02-01' AND DATE '2024-02-20' AS by_effective,
       CAST(first_seen + INTERVAL 8 HOUR AS DATE) BETWEEN DATE '2024-02-01' AND DATE '2024-02-20' AS by_first_seen,
       COALESCE(deadline_type = 'closing' AND deadline >= DATE '2024-02-01', FALSE) AS by_deadline FROM ads""")
def date_basis_filter(spark, sf):
    span = ("2024-02-01", "2024-02-20")
    return X.ads(spark, sf).select(
        "id", search.in_range(search.date_basis("effective"), *span).alias("by_effective"),
        search.in_range(search.date_basis("first_seen"), *span).alias("by_first_seen"),
        search.in_range(search.date_basis("deadline"), "2024-02-01").alias("by_deadline"))


@query("status_filter", cte(X.ADS) + "SELECT id, status FROM ads WHERE status = 'open'")
def status_filter(spark, sf):
    return X.ads(spark, sf).filter(search.status_filter("open")).select("id", "status")


@query("institution_filter", cte(X.ADS) + """
SELECT id, source_id IN ('src1', 'src4') AS chosen, FALSE AS none_chosen, employment_type IN ('part-time', 'hourly') AS rule_without_institutions,
       employment_type IN ('part-time', 'hourly') AND source_id IN ('src1', 'src4') AS rule_with_institutions FROM ads""")
def institution_filter(spark, sf):
    # An empty list selects nothing in a search, but every institution in a notification rule.
    rule = lambda chosen: rules.is_match(F.array(F.lit(1)), F.lit(V.MIN_SCORE), F.lit(V.NOTIFY_ROLES[0]), F.col("employment_type"),
                                         F.col("source_id"), F.lit(""), institutions=chosen)
    return X.ads(spark, sf).select(
        "id", search.institution_filter(("src1", "src4")).alias("chosen"), search.institution_filter(()).alias("none_chosen"),
        rule([]).alias("rule_without_institutions"), rule(["src1", "src4"]).alias("rule_with_institutions"))


@query("parttime_filter", cte(X.ADS) + """
SELECT id, employment_type FROM ads WHERE employment_type IN ('part-time', 'hourly', 'mixed')""")
def parttime_filter(spark, sf):
    return X.ads(spark, sf).filter(search.part_time_filter()).select("id", "employment_type")


@query("detail_reuse", cte(*ACC, CARRY, DENSE, """
f AS (SELECT *, title || '|' || department AS fingerprint,
             LAG(run_date) OVER (PARTITION BY source_id, job_key ORDER BY run_date) AS before_date FROM obs),
fin AS (SELECT source_id, job_key, o_date, arg_max(status, run_date) AS end_status FROM dense GROUP BY 1, 2, 3),
rj AS (SELECT f.*, c.title AS c_title, c.department AS c_department, c.description AS c_description, c.match_text AS c_match,
              c.employment_type AS c_employment, c.posted_date AS c_posted, c.deadline AS c_deadline, c.deadline_type AS c_type,
              c.deadline_raw AS c_raw, c.detail_verified_at AS c_verified,
              COALESCE(c.detail_complete AND c.description <> '' AND NOT c.detail_refresh_failed AND NOT c.source_closed
                AND end_status NOT IN ('missing', 'closed') AND b.fingerprint = f.fingerprint
                AND c.detail_verified_at IS NOT NULL AND f.run_date - c.detail_verified_at >= 0
                AND f.run_date - c.detail_verified_at < LEAST(7, GREATEST(1, f.source_id))
                AND NOT COALESCE(c.deadline_type = 'closing' AND c.deadline <= f.run_date + 3, FALSE), FALSE) AS reused
       FROM f LEFT JOIN f b ON b.source_id = f.source_id AND b.job_key = f.job_key AND b.run_date = f.before_date
       LEFT JOIN carried c ON c.source_id = f.source_id AND c.job_key = f.job_key AND c.run_date = f.before_date
       LEFT JOIN fin n ON n.source_id = f.source_id AND n.job_key = f.job_key AND n.o_date = f.before_date)""") + """
SELECT source_id, job_key, CAST(run_date AS VARCHAR) AS run_date, reused AS detail_from_cache,
       reused OR detail_complete AS detail_complete, NOT reused AND detail_refresh_failed AS detail_refresh_failed,
       CASE WHEN reused THEN c_title ELSE title END AS title, CASE WHEN reused THEN c_department ELSE department END AS department,
       CASE WHEN reused THEN c_description ELSE description END AS description, CASE WHEN reused THEN c_match ELSE match_text END AS match_text,
       CASE WHEN reused THEN c_employment ELSE employment_type END AS employment_type,
       CAST(CASE WHEN reused THEN c_posted ELSE posted_date END AS VARCHAR) AS posted_date,
       CAST(CASE WHEN reused THEN c_deadline ELSE deadline END AS VARCHAR) AS deadline,
       CASE WHEN reused THEN c_type ELSE deadline_type END AS deadline_type, CASE WHEN reused THEN c_raw ELSE deadline_raw END AS deadline_raw,
       CAST(CASE WHEN reused THEN c_verified WHEN detail_complete THEN run_date END AS VARCHAR) AS detail_verified_at
FROM rj""")
def detail_reuse(spark, sf):
    line = obs_timeline(spark, sf)
    # The listing row's own fields, before any verified detail is carried into them.
    listed = X.obs(spark, sf).withColumn("fingerprint", F.concat_ws("|", "title", "department")).withColumn(
        "detail_verified_at", F.when(F.col("detail_complete"), F.col("run_date")))
    stored = line.select("source_id", "job_key", "run_date", F.struct(
        *reconcile.CACHED_FIELDS, "detail_complete", "source_closed", F.col("end_status").alias("status"),
        F.col("detail_refresh_failed").alias("refresh_failed")).alias("now"))
    w = Window.partitionBy("source_id", "job_key").orderBy("run_date")
    rows = listed.join(stored, ["source_id", "job_key", "run_date"]).withColumn(
        "old", F.lag(F.struct("now.*", "fingerprint")).over(w))
    out = reconcile.with_cached_detail(rows, F.col("run_date"), F.col("source_id"))
    dates = ("posted_date", "deadline", "detail_verified_at")
    return out.select("source_id", "job_key", day("run_date").alias("run_date"), "detail_from_cache", "detail_complete",
                      "detail_refresh_failed", *[day(c).alias(c) if c in dates else c for c in reconcile.CACHED_FIELDS])


GATE = """
ev AS (SELECT source_id, job_key, first_seen, 'new:' || source_id || '-' || job_key AS event_id FROM state),
gated AS (SELECT e.event_id, CASE WHEN NOT c.detail_complete AND s.status = 'open' THEN 'defer'
              WHEN s.job_key % 3 = 0 OR s.status <> 'open' THEN 'suppress' ELSE 'send' END AS decision
          FROM ev e JOIN state s ON s.source_id = e.source_id AND s.job_key = e.job_key
          JOIN carried c ON c.source_id = s.source_id AND c.job_key = s.job_key AND c.run_date = s.last_date
          WHERE NOT (e.source_id = 3 AND e.job_key = 5)
          UNION ALL SELECT event_id, 'suppress' FROM ev WHERE source_id = 3 AND job_key = 5)
"""


def gate_inputs(spark, sf):
    """Events for every record, and the current records (one of them withdrawn)."""
    state = lifecycle.current_state(obs_timeline(spark, sf)).withColumn(
        "id", F.concat_ws("-", "source_id", "job_key")).withColumn("matches", F.col("job_key") % 3 != 0)
    events = state.select(F.concat(F.lit("new:"), "id").alias("event_id"), "id", F.col("first_seen").alias("created_at"))
    return events, state.filter("id <> '3-5'")


@query("notify_gate", cte(*ACC, CARRY, DENSE, STATE, GATE) + "SELECT event_id, decision FROM gated")
def notify_gate(spark, sf):
    return outbox.gate(*gate_inputs(spark, sf)).select("event_id", "decision")


@query("health_filter", cte(*HEALTH_CTE) + """
SELECT source_id, CAST(run_date AS VARCHAR) AS run_date, status, severity FROM health WHERE status <> 'ok'""")
def health_filter(spark, sf):
    return health_state(spark, sf).filter("status <> 'ok' AND status IS NOT NULL").select(
        "source_id", day("run_date").alias("run_date"), "status", "severity")
