"""Helpers shared by the registered queries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixtures as X
from ..operators import listing, lifecycle


def cte(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n"


def day(c: str | Column) -> Column:
    """Dates leave the queries as ISO text, so every engine prints them alike."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def as_of() -> Column:
    return F.lit(X.AS_OF).cast("date")


def joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def accepted_runs(spark, sf: str) -> DataFrame:
    return listing.volume_fold(X.listed_runs(spark, sf))


def obs_timeline(spark, sf: str) -> DataFrame:
    return lifecycle.timeline(X.obs(spark, sf), accepted_runs(spark, sf))


# --- SQL statements of the same intermediate results, stated densely ---------

ACC = (X.OBS, X.RUNS, X.LISTED, X.ACCEPTED)

# carried fields by counting kept observations
CARRY = """
c0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id, job_key ORDER BY run_date) = 1 AS is_first FROM obs),
c1 AS (SELECT *, (detail_complete OR is_first) AS k_sure,
              (detail_complete OR is_first OR department <> '') AS k_dep,
              (detail_complete OR is_first OR posted_date IS NOT NULL) AS k_posted,
              (detail_complete OR is_first OR deadline_type NOT IN ('unknown', 'screening-or-closing')) AS k_dead,
              (detail_complete OR is_first OR listing_fingerprint <> '') AS k_finger,
              (detail_complete OR detail_refresh_failed) AS k_failed,
              (detail_complete OR source_closed) AS k_closed FROM c0),
c2 AS (SELECT *,
   SUM(CASE WHEN k_sure THEN 1 ELSE 0 END) OVER w AS g_sure, SUM(CASE WHEN k_dep THEN 1 ELSE 0 END) OVER w AS g_dep,
   SUM(CASE WHEN k_posted THEN 1 ELSE 0 END) OVER w AS g_posted, SUM(CASE WHEN k_dead THEN 1 ELSE 0 END) OVER w AS g_dead,
   SUM(CASE WHEN k_closed THEN 1 ELSE 0 END) OVER w AS g_closed, SUM(CASE WHEN k_finger THEN 1 ELSE 0 END) OVER w AS g_finger,
   SUM(CASE WHEN k_failed THEN 1 ELSE 0 END) OVER w AS g_failed,
   MAX(CASE WHEN detail_complete THEN run_date END) OVER w AS verified
   FROM c1 WINDOW w AS (PARTITION BY source_id, job_key ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
carried AS (
  SELECT o.source_id, o.job_key, o.run_date, o.event_id, o.detail_complete, o.value,
         a.title, d.department, p.posted_date, z.deadline, z.deadline_type, o.verified AS detail_verified_at,
         COALESCE(q.source_closed, FALSE) AS source_closed, a.description, a.match_text, a.employment_type,
         z.deadline_raw, i.listing_fingerprint, COALESCE(x.detail_refresh_failed, FALSE) AS detail_refresh_failed
  FROM c2 o
  JOIN c2 a ON a.source_id = o.source_id AND a.job_key = o.job_key AND a.k_sure AND a.g_sure = o.g_sure
  JOIN c2 d ON d.source_id = o.source_id AND d.job_key = o.job_key AND d.k_dep AND d.g_dep = o.g_dep
  JOIN c2 p ON p.source_id = o.source_id AND p.job_key = o.job_key AND p.k_posted AND p.g_posted = o.g_posted
  JOIN c2 z ON z.source_id = o.source_id AND z.job_key = o.job_key AND z.k_dead AND z.g_dead = o.g_dead
  LEFT JOIN c2 q ON q.source_id = o.source_id AND q.job_key = o.job_key AND q.k_closed AND q.g_closed = o.g_closed
  JOIN c2 i ON i.source_id = o.source_id AND i.job_key = o.job_key AND i.k_finger AND i.g_finger = o.g_finger
  LEFT JOIN c2 x ON x.source_id = o.source_id AND x.job_key = o.job_key AND x.k_failed AND x.g_failed = o.g_failed)
"""

# one row per (record, run since its first sighting), as a run-by-run reconcile would see it
DENSE = """
firsts AS (SELECT source_id, job_key, MIN(run_date) AS first_seen FROM obs GROUP BY 1, 2),
grid AS (SELECT f.source_id, f.job_key, a.run_date, a.accepted,
                (c.run_date IS NOT NULL) AS present, c.title, c.department, c.posted_date, c.deadline, c.deadline_type,
                c.description, c.match_text, c.employment_type, c.deadline_raw,
                c.source_closed, c.detail_complete, c.event_id, c.value, c.detail_verified_at
         FROM firsts f JOIN accepted a ON a.source_id = f.source_id AND a.run_date >= f.first_seen
         LEFT JOIN carried c ON c.source_id = f.source_id AND c.job_key = f.job_key AND c.run_date = a.run_date),
isl AS (SELECT *, SUM(CASE WHEN present THEN 1 ELSE 0 END) OVER
               (PARTITION BY source_id, job_key ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
        FROM grid),
cnt AS (SELECT *,
   SUM(CASE WHEN accepted AND NOT present THEN 1 ELSE 0 END) OVER wi AS missing_count,
   MAX(CASE WHEN present THEN deadline_type END) OVER wp AS o_type,
   MAX(CASE WHEN present THEN deadline END) OVER wp AS o_deadline,
   BOOL_OR(present AND source_closed) OVER wp AS o_closed,
   MAX(CASE WHEN present THEN run_date END) OVER wp AS o_date
   FROM isl WINDOW wi AS (PARTITION BY source_id, job_key, island ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   wp AS (PARTITION BY source_id, job_key, island)),
stat AS (SELECT *,
   CASE WHEN o_closed OR (o_type = 'closing' AND o_deadline IS NOT NULL AND o_deadline < o_date) THEN 'closed'
        WHEN BOOL_OR(accepted AND NOT present AND o_type = 'closing' AND o_deadline IS NOT NULL AND o_deadline < run_date)
             OVER (PARTITION BY source_id, job_key, island ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) THEN 'closed'
        WHEN missing_count >= 3 THEN 'missing' ELSE 'open' END AS status
   FROM cnt),
dense AS (SELECT *, LAG(status) OVER (PARTITION BY source_id, job_key ORDER BY run_date) AS prev_status FROM stat)
"""


# --- SQL forms of shared text columns ----------------------------------------

def sql_unescape(e: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        e = f"replace({e}, '{entity}', '{char}')"
    return e


def sql_inline(e: str) -> str:
    flat = sql_unescape(f"regexp_replace({e}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({flat}, '\\s+', ' ', 'g'))"


def sql_clean(e: str) -> str:
    line = f"trim(regexp_replace(x, '[\\t {chr(160)}]+', ' ', 'g'))"
    return (f"array_to_string(list_filter(list_transform(string_split({e}, chr(10)), lambda x: {line}), "
            f"lambda x: x <> ''), chr(10))")


def sql_page_text(e: str) -> str:
    for block in ("<!--.*?-->", "<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>",
                  "<noscript[^>]*>.*?</noscript>", "<!doctype[^>]*>"):
        e = f"regexp_replace({e}, '(?is){block}', '', 'g')"
    e = f"regexp_replace({e}, '(?i)<br[^>]*>|</(p|li|tr|h[1-4])>', chr(10), 'g')"
    return sql_clean(sql_unescape(f"regexp_replace({e}, '(?s)<[^>]*>', ' ', 'g')"))


def sql_fold(e: str) -> str:
    """Normalised text, for text whose compatibility form is itself."""
    e = f"regexp_replace(lower({e}), '[‐‑‒–—−]', '-', 'g')"
    e = f"regexp_replace({e}, '\\bpart[\\s-]*time\\b', 'parttime', 'g')"
    e = f"regexp_replace({e}, '\\bfull[\\s-]*time\\b', 'fulltime', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
