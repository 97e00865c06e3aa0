"""Column expressions, applied to whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import fixtures as X
from ..functions import dates, keys, rules, text
from ..operators import health, outbox, search
from ..registry import query
from ..sources.tables import table, text_table
from .common import cte, day, joined, sql_clean, sql_fold
from .joins import MATCH, SEARCHES, scored
from .ordering import DIGEST_LINES
from .sequences import HEALTH_CTE, health_state

_MESSY = "replace(text, '. ', '. ' || {chr}(9) || ' ' || {chr}(160) || {chr}(10) || '  ')"


@query("clean_text", f"SELECT doc_id, {sql_clean(_MESSY.format(chr='chr'))} AS text FROM documents")
def clean_text(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", text.clean_text(F.expr(_MESSY.format(chr="char"))).alias("text"))


_WIDE = "CASE WHEN doc_id % 4 = 0 THEN 'Ｐａｒｔ－ｔｉｍｅ ＡＩ ' ELSE 'FULL — Time ' END || {} || ' ' || text"
_WIDE_PLAIN = "CASE WHEN doc_id % 4 = 0 THEN 'Part-time AI ' ELSE 'FULL — Time ' END || {} || ' ' || text"


@query("normalize_text", cte(X.ADVERTS) + f"""
SELECT d.doc_id, {sql_fold("replace(replace(" + _WIDE_PLAIN.format('title').replace('doc_id', 'd.doc_id').replace('text', 'd.text') + ", '（', '('), '）', ')')")} AS text
FROM documents d JOIN adverts a ON a.doc_id = d.doc_id""")
def normalize_text(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", "text", X._advert_columns()[0])
    return d.select("doc_id", text.normalize_text(F.expr(_WIDE.format("title"))).alias("text"))


_BOUNDED = ["the", "ch", "critical thinking", "批判思考", "AI", ""]


def _re2(term: str, plural: bool = False) -> str:
    t = term.lower()
    if not t:
        return "FALSE"
    if not t.isascii():
        return f"contains(f, '{t}')"
    return f"regexp_matches(f, '(^|[^a-z0-9]){t}{'s?' if plural else ''}([^a-z0-9]|$)')"


@query("bounded_contains", cte(X.ADVERTS, f"g AS (SELECT doc_id, {sql_fold('description')} AS f FROM adverts)") +
       "SELECT doc_id, " + ", ".join(f"{_re2(t)} AS t{i}" for i, t in enumerate(_BOUNDED)) + " FROM g")
def bounded_contains(spark, sf):
    g = X.adverts(spark, sf).select("doc_id", text.normalize_text(F.col("description")).alias("f"))
    return g.select("doc_id", *[text.contains_term(F.col("f"), t).alias(f"t{i}") for i, t in enumerate(_BOUNDED)])


_SEARCHED = ["lecturer", "parttime", "AI", "tutor", "ethic"]


@query("search_term_match", cte(X.ADVERTS, f"g AS (SELECT doc_id, {sql_fold('title || chr(10) || description')} AS f FROM adverts)") +
       "SELECT doc_id, " + ", ".join(f"{_re2(t, True)} AS t{i}" for i, t in enumerate(_SEARCHED)) + " FROM g")
def search_term_match(spark, sf):
    g = X.adverts(spark, sf).select("doc_id", text.normalize_text(F.concat_ws("\n", "title", "description")).alias("f"))
    return g.select("doc_id", *[text.contains_term(F.col("f"), t, plural=True).alias(f"t{i}") for i, t in enumerate(_SEARCHED)])


_WORDS = "regexp_extract_all(text, '[a-z]+'{})"


def _words(spark, sf):
    # the words are cut out once, and only from the piece that holds the first four
    head = F.regexp_extract("text", r"\A(?:[^a-z]*+[a-z]++){0,4}", 0)
    w = text_table(spark, sf, "documents").select("doc_id", "text", F.regexp_extract_all(head, F.lit("[a-z]+"), F.lit(0)).alias("_w"))
    return w.select("doc_id", "text", *[
        F.coalesce(F.try_element_at("_w", F.lit(i)), F.lit("none")).alias(f"w{i}") for i in (1, 2, 3, 4)])


_TYPED = """'"' || w1 || ' ' || w2 || '" -' || w3 || '，-"' || w1 || ' x",' || w4 || CASE WHEN doc_id % 4 = 0 THEN ' "open' ELSE '' END || ' ' || text"""


def _typed(spark, sf):
    """A query of every kind of term, followed by the whole text of the document."""
    return _words(spark, sf).withColumn("q", F.concat(
        F.lit('"'), "w1", F.lit(" "), "w2", F.lit('" -'), "w3", F.lit("，-\""), "w1", F.lit(' x",'), "w4",
        F.when(F.col("doc_id") % 4 == 0, ' "open').otherwise(""), F.lit(" "), F.coalesce("text", F.lit(""))))


@query("parse_query", f"""WITH w0 AS (SELECT doc_id, COALESCE(text, '') AS text, {", ".join(f"COALESCE(regexp_extract_all(text, '[a-z]+')[{i}], 'none') AS w{i}" for i in (1, 2, 3, 4))} FROM documents),
q AS (SELECT doc_id, {_TYPED} AS q FROM w0),
t AS (SELECT doc_id, q, list_filter(list_transform(regexp_extract_all(q, '(-?"[^"]+"|[^\\s,，"]+)', 1),
        lambda x: {{'minus': starts_with(x, '-'), 'term': trim(replace(regexp_replace(x, '^-', ''), '"', ''), ' ')}}), lambda x: x.term <> '') AS t FROM q)
SELECT doc_id, array_to_string(list_transform(list_filter(t, lambda x: NOT x.minus), lambda x: x.term), '|') AS positive,
  array_to_string(list_transform(list_filter(t, lambda x: x.minus), lambda x: x.term), '|') AS negative,
  (length(q) - length(replace(q, '"', ''))) % 2 = 1 AS unclosed_quote FROM t""")
def parse_query(spark, sf):
    return _typed(spark, sf).select("doc_id", search.parse_query(F.col("q")).alias("p")).select(
        "doc_id", joined(F.col("p.positive")).alias("positive"), joined(F.col("p.negative")).alias("negative"), "p.unclosed_quote")


@query("keyword_terms", """
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(' a b, ，' || COALESCE(text, '') || chr(10) || chr(10) || ' c ,', '[,，\n]'),
  lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS terms FROM documents""")
def keyword_terms(spark, sf):
    raw = F.concat(F.lit(" a b, ，"), F.coalesce("text", F.lit("")), F.lit("\n\n c ,"))
    return table(spark, sf, "documents").select("doc_id", joined(search.keyword_terms(raw)).alias("terms"))


# --- dates -------------------------------------------------------------------

@query("parse_date", cte(X.DATE_TEXTS) + """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 NOT IN (4, 6) THEN CAST(expected AS VARCHAR) END AS parsed FROM date_texts""")
def parse_date(spark, sf):
    return X.date_texts(spark, sf).select("o_orderkey", day(dates.parse_date(F.col("txt"))).alias("parsed"))


@query("parse_date_locale", cte(X.DATE_TEXTS) + """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(expected AS VARCHAR) END AS numeric_date,
       CASE WHEN o_orderkey % 4 <> 0 THEN CAST(expected AS VARCHAR) END AS feed_date, CAST(expected + 1 AS VARCHAR) AS stamp_date,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(expected AS VARCHAR) END AS marked_date FROM date_texts""")
def parse_date_locale(spark, sf):
    d = X.date_texts(spark, sf)
    order = F.when(F.col("o_orderkey") % 3 == 0, "DMY")
    numeric = dates.parse_date_locale(F.date_format("expected", "d/M/yyyy"), order)
    feed = dates.feed_date_mdy(F.when(F.col("o_orderkey") % 4 == 0, "-").otherwise(F.date_format("expected", "M/d/yyyy")))
    stamp = dates.feed_stamp_utc(F.date_format("expected", "EEE MMM dd '23:15:00 UTC' yyyy"))
    marked = dates.parse_date_locale(F.when(F.col("o_orderkey") % 5 == 0, "31/13/2024").otherwise(
        F.concat(F.lit("‎"), F.date_format("expected", "yyyy‎-M-d"))), F.lit("DMY"))
    return d.select("o_orderkey", day(numeric).alias("numeric_date"), day(feed).alias("feed_date"),
                    day(stamp).alias("stamp_date"), day(marked).alias("marked_date"))


@query("local_date", """
SELECT event_id, CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS from_utc,
       CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS from_offset, CAST(CAST(ts AS DATE) AS VARCHAR) AS plain FROM events""")
def local_date(spark, sf):
    ts = F.col("ts")
    utc = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    offset = F.date_format(F.expr("ts - INTERVAL '5' HOUR"), "yyyy-MM-dd'T'HH:mm:ss'-05:00'")
    return table(spark, sf, "events").select(
        "event_id", day(dates.local_date(utc)).alias("from_utc"), day(dates.local_date(offset)).alias("from_offset"),
        day(dates.local_date(F.date_format(ts, "yyyy-MM-dd"))).alias("plain"))


_AROUND = "'About us' || {chr}(10) || '  ' || txt || '  ' || {chr}(10) || {chr}(10) || 'Apply online' || {chr}(10) || 'More'"


@query("deadline_from", cte(X.DATE_TEXTS) + """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 2, 3, 7) THEN 'closing' WHEN o_orderkey % 8 = 4 THEN 'until-filled'
         WHEN o_orderkey % 8 = 5 THEN 'review' ELSE 'unknown' END AS deadline_type,
       CASE WHEN o_orderkey % 8 IN (0, 2, 3, 5, 7) THEN CAST(expected AS VARCHAR) END AS deadline,
       CASE WHEN o_orderkey % 8 IN (0, 2, 3, 4, 7) THEN txt || ' Apply online More' WHEN o_orderkey % 8 = 5 THEN txt ELSE '' END AS deadline_raw
FROM date_texts""")
def deadline_from(spark, sf):
    body = F.expr(_AROUND.format(chr="char"))
    return X.date_texts(spark, sf).select("o_orderkey", dates.deadline_from(body).alias("d")).select(
        "o_orderkey", "d.deadline_type", day("d.deadline").alias("deadline"), "d.deadline_raw")


@query("posted_from", cte(X.DATE_TEXTS) + """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 1 THEN CAST(expected AS VARCHAR) END AS posted,
       CAST(expected AS VARCHAR) AS posted_next_line FROM date_texts""")
def posted_from(spark, sf):
    below = F.concat(F.lit("Posting date:\n"), F.date_format("expected", "yyyy-MM-dd"), F.lit("\nend"))
    return X.date_texts(spark, sf).select(
        "o_orderkey", day(dates.posted_from(F.expr(_AROUND.format(chr="char")))).alias("posted"),
        day(dates.posted_from(below)).alias("posted_next_line"))


@query("explicit_apply_by", cte(X.DATE_TEXTS) + """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'closing' ELSE 'until-filled' END AS deadline_type,
       CASE WHEN o_orderkey % 3 < 2 THEN CAST(expected AS VARCHAR) END AS deadline FROM date_texts""")
def explicit_apply_by(spark, sf):
    d = F.date_format("expected", "d MMMM yyyy")
    split_year = F.concat(F.date_format("expected", "d MMMM "), F.substring(d, -4, 3), F.lit(" "), F.substring(d, -1, 1))
    body = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Please submit your application by "), d, F.lit(".\n")))
                    .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Apply on or before "), split_year, F.lit(".\n")))
                    .otherwise(""), F.lit("Recruitment continues until the post is filled."))
    return X.date_texts(spark, sf).select("o_orderkey", dates.deadline_with_apply_by(body).alias("d")).select(
        "o_orderkey", "d.deadline_type", day("d.deadline").alias("deadline"))


# --- keys --------------------------------------------------------------------

_BASE = "regexp_extract(url, '^([^?#]+)', 1)"
_QUERY = "CASE WHEN contains(url, '?page') THEN '&page=2&ref=x' WHEN contains(url, '?utm') THEN '&utm_source=feed' ELSE '' END"
_FRAG = "CASE WHEN contains(url, '#') THEN '#top' ELSE '' END"


@query("canonical_url", f"""
SELECT page_id, {_BASE} || '?A=b+c&e=' || CASE WHEN contains(url, '?page') THEN '&page=2&ref=x' ELSE '' END || '&z=%C3%A9' || {_FRAG} AS canonical FROM pages""")
def canonical_url(spark, sf):
    raw = F.expr(f"upper(substring_index(url, ':', 1)) || substr({_BASE}, length(substring_index(url, ':', 1)) + 1)"
                 f" || '?z=%c3%a9{{}}&lang=en&UTM_x=1&A=b%20c&e&job-mail-subscribe-privacy=y' || {_FRAG}".replace(
                     "{}", "' || " + _QUERY + " || '"))
    return table(spark, sf, "pages").select("page_id", keys.canonical_url(raw).alias("canonical"))


@query("query_param", """
SELECT page_id, CASE WHEN contains(url, 'page=2') THEN '2' END AS page, CASE WHEN contains(url, 'ref=x') THEN 'x' END AS ref,
       NOT contains(url, 'page=') AS rejected FROM pages""")
def query_param(spark, sf):
    page = keys.query_param(F.col("url"), "page")
    return table(spark, sf, "pages").select("page_id", page.alias("page"), keys.query_param(F.col("url"), "ref").alias("ref"),
                                            page.isNull().alias("rejected"))


@query("stable_key", f"""
SELECT page_id, substr(sha256('g' || (page_id % 5) || chr(0) || CASE WHEN page_id % 2 = 0 THEN 'AB' || page_id ELSE {_BASE} ||
   CASE WHEN contains(url, '?page') THEN '?page=2&ref=x' ELSE '' END || {_FRAG} END), 1, 24) AS id FROM pages""")
def stable_key(spark, sf):
    ref = F.expr("CASE WHEN page_id % 2 = 0 THEN 'a b ' || page_id ELSE '' END")
    return table(spark, sf, "pages").select("page_id", keys.stable_key(F.expr("'g' || (page_id % 5)"), ref, F.col("url")).alias("id"))


@query("content_hash", cte(X.ADS, X.ADVERTS) + """
SELECT a.doc_id, sha256(concat_ws(chr(31), v.title, v.department, a.employment_type, COALESCE(CAST(a.posted_date AS VARCHAR), chr(30)),
  COALESCE(CAST(a.deadline AS VARCHAR), chr(30)), a.deadline_type, chr(30), v.description, chr(30))) AS content_hash
FROM ads a JOIN adverts v ON v.doc_id = a.doc_id""")
def content_hash(spark, sf):
    names = ["title", "department", "employment_type", "posted_date", "deadline", "deadline_type", "description"]
    return X.search_ads(spark, sf).select("doc_id", keys.content_hash(**{n: F.col(n) for n in names}).alias("content_hash"))


@query("listing_fingerprint", cte(X.OBS) + """
SELECT source_id, job_key, CAST(run_date AS VARCHAR) AS run_date, sha256(concat_ws(chr(31), chr(30), chr(30), title, department,
  COALESCE(CAST(posted_date AS VARCHAR), chr(30)), COALESCE(CAST(deadline AS VARCHAR), chr(30)), deadline_type, chr(30), chr(30))) AS fingerprint FROM obs""")
def listing_fingerprint(spark, sf):
    names = ["title", "department", "posted_date", "deadline", "deadline_type"]
    return X.obs(spark, sf).select("source_id", "job_key", day("run_date").alias("run_date"),
                                   keys.listing_fingerprint(**{n: F.col(n) for n in names}).alias("fingerprint"))


# --- rules -------------------------------------------------------------------

@query("role_of", cte(X.ADVERTS, MATCH) + "SELECT doc_id, role FROM roles")
def role_of(spark, sf):
    return X.adverts(spark, sf).select("doc_id", rules.role_of(F.col("title")).alias("role"))


@query("employment_of", cte(X.ADVERTS, MATCH) + "SELECT doc_id, employment FROM roles")
def employment_of(spark, sf):
    a = rules.with_employment(X.adverts(spark, sf), F.col("title"), None, F.col("description"))
    return a.select("doc_id", F.col("employment_type").alias("employment"))


_CAPABILITIES = ["full", "list_only", "partial", "manual", "pending"]
_GIVEN = ["", "ok", "warning", "error"]


@query("severity_status", cte(X.RUNS, "cap(capability) AS (VALUES " + ", ".join(f"('{c}')" for c in _CAPABILITIES) + ")",
       "giv(given) AS (VALUES " + ", ".join(f"('{g}')" for g in _GIVEN) + ")", """
r AS (SELECT source_id, run_date, capability, given, n_events % 5 = 0 AS guarded, listing_complete AND n_events % 5 <> 0 AS lc,
             status = 'ok' AND n_events % 5 <> 0 AS complete, n_events % 3 AS n, capability IN ('manual', 'pending') AS silent FROM runs CROSS JOIN cap CROSS JOIN giv),
s1 AS (SELECT *, CASE WHEN guarded OR (NOT lc AND NOT silent) THEN 'error' WHEN given <> '' THEN given WHEN complete THEN 'ok'
         WHEN silent OR (lc AND capability IN ('list_only', 'partial')) THEN 'warning' ELSE 'error' END AS s FROM r),
s2 AS (SELECT *, CASE WHEN s = 'ok' AND NOT complete THEN CASE WHEN lc THEN 'warning' ELSE 'error' END ELSE s END AS severity FROM s1)""") + """
SELECT source_id, CAST(run_date AS VARCHAR) AS run_date, capability, given, severity, CASE WHEN severity = 'warning' AND silent THEN capability
       WHEN complete THEN 'ok' WHEN n > 0 OR lc THEN 'partial' ELSE 'error' END AS status FROM s2""")
def severity_status(spark, sf):
    # A fixed table of 20 settings per run, built inside the row.
    r = X.runs(spark, sf).withColumn("capability", F.explode(F.array(*map(F.lit, _CAPABILITIES)))).withColumn(
        "given", F.explode(F.array(*map(F.lit, _GIVEN))))
    kept = F.col("n_events") % 5 != 0
    v = health.severity_and_status(~kept, F.col("listing_complete") & kept, (F.col("status") == "ok") & kept,
                                   F.col("capability"), F.col("n_events") % 3, F.nullif(F.col("given"), F.lit("")))
    return r.withColumn("v", v).select("source_id", day("run_date").alias("run_date"), "capability", "given", "v.severity", "v.status")


@query("source_state_label", cte(*HEALTH_CTE, """
l AS (SELECT *, MAX(CASE WHEN accepted THEN run_date END) OVER (PARTITION BY source_id ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_listing FROM health)""") + """
SELECT source_id, CAST(run_date AS VARCHAR) AS run_date, CASE WHEN source_id = 7 AND n_jobs % 2 = 0 THEN 'pending'
  WHEN severity = 'error' OR status = 'error' THEN 'error' WHEN capability IN ('manual', 'pending') THEN capability
  WHEN last_listing IS NOT NULL AND (run_date - last_listing) * 24 + 20 > 36 THEN 'stale' WHEN status = 'ok' THEN 'ok'
  WHEN accepted AND capability IN ('list_only', 'partial') THEN 'limited' ELSE 'partial' END AS label FROM l""")
def source_state_label(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("source_id").orderBy("run_date").rowsBetween(Window.unboundedPreceding, 0)
    h = health_state(spark, sf).withColumn(
        "last_listing", F.max(F.when(F.col("accepted"), F.col("run_date"))).over(w).cast("timestamp"))
    now = F.col("run_date").cast("timestamp") + F.expr("INTERVAL '20' HOUR")
    label = health.state_label(~((F.col("source_id") == 7) & (F.col("n_jobs") % 2 == 0)), F.col("status"), F.col("capability"),
                               F.col("severity"), F.col("accepted"), F.col("last_listing"), F.lit(None).cast("timestamp"), now)
    return h.select("source_id", day("run_date").alias("run_date"), label.alias("label"))


_MESSAGES = [m for m, _ in V.ERROR_LABELS] + ["HOSTNAME MISMATCH, CERTIFICATE HAS EXPIRED", "RESET BY PEER"]
_MESSAGE_CASE = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN 'ssl: {m.lower()} (host ' || user_id || ')'" for i, m in enumerate(_MESSAGES)) + " END"
_LABEL_CASE = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{lab}'" for i, (_, lab) in enumerate(V.ERROR_LABELS)) + \
    f" WHEN 10 THEN '{V.ERROR_LABELS[2][1]}' ELSE '{V.ERROR_DEFAULT}' END"


def error_category_of(message):
    """Fixed label of the first marker in list order; the message itself is never shown."""
    upper, out = F.upper(message), None
    for marker, label in V.ERROR_LABELS:
        test = upper.contains(marker)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(V.ERROR_DEFAULT)


@query("error_category", f"SELECT event_id, {_LABEL_CASE} AS label FROM events")
def error_category(spark, sf):
    return table(spark, sf, "events").select("event_id", error_category_of(F.expr(_MESSAGE_CASE)).alias("label"))


# --- messages ------------------------------------------------------------------

_MARKED = "text || '*_`~>|[x](y) {b}'".replace("{b}", "\\")


@query("escape_text", r"""
WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '=' ELSE '' END || text || '"q"' AS cell FROM documents)
SELECT doc_id, regexp_replace(text || '*_`~>|[x](y) ' || chr(92), '([\\*_`~>|\[\]])', chr(92) || chr(92) || chr(92) || '1', 'g') AS escaped,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://e.org/%28' || doc_id || '%29%20x' END AS link,
  '"' || replace(CASE WHEN regexp_matches(cell, '^\s*[=+@-]') THEN '''' || cell ELSE cell END, '"', '""') || '"' AS cell FROM c""")
def escape_text(spark, sf):
    raw = F.concat("text", F.lit("*_`~>|[x](y) \\"))
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("http://e.org/"), "doc_id")).otherwise(
        F.concat(F.lit("https://e.org/("), "doc_id", F.lit(") x")))
    cell = F.concat(F.when(F.col("doc_id") % 2 == 0, "=").otherwise(""), "text", F.lit('"q"'))
    return table(spark, sf, "documents").select("doc_id", text.escape_markdown(raw, 2**31 - 1).alias("escaped"),
                                                text.safe_link(url).alias("link"), text.csv_cell(cell).alias("cell"))


@query("render_message", cte(X.ADS, X.ADVERTS, MATCH, """
lab AS (SELECT doc_id, string_agg(CASE subject """ + " ".join(f"WHEN '{s}' THEN '{lab}'" for s, lab, _, _ in V.SUBJECTS) + """ END, '、' ORDER BY
  CASE subject """ + " ".join(f"WHEN '{s}' THEN {i}" for i, (s, _, _, _) in enumerate(V.SUBJECTS)) + """ END) AS labels FROM per GROUP BY 1)""") + """
SELECT a.doc_id, '新發現相關職位｜' || a.source_id || chr(10) || '**' || v.title || '**' || chr(10) || '刊登：' || COALESCE(CAST(a.posted_date AS VARCHAR), '網站未提供')
  || '｜首見：' || strftime(a.first_seen, '%Y-%m-%d') || chr(10) || '科目：' || COALESCE(l.labels, '') || chr(10) || '截止：' ||
  CASE WHEN a.deadline_type = 'closing' THEN COALESCE(CAST(a.deadline AS VARCHAR), '請查看原文') ELSE '請查看原文／持續招聘' END || chr(10)
  || 'https://jobs.example.edu/' || a.doc_id || chr(10) || '相關度只反映科目及聘用類型，請自行核對學歷和經驗要求。' AS content
FROM ads a JOIN adverts v ON v.doc_id = a.doc_id LEFT JOIN lab l ON l.doc_id = a.doc_id""")
def render_message(spark, sf):
    a = X.search_ads(spark, sf)
    e = rules.with_subject_hits(a, rules.subject_text(F.col("title"), F.col("department"), F.lit(""), F.col("description")))
    labels = F.array_join(F.transform("hits", lambda h: h["label"]), "、")
    return e.select("doc_id", outbox.new_job_message(
        F.col("source_id"), F.col("title"), F.col("posted_date"), F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss"), labels,
        F.col("deadline_type"), F.col("deadline"), F.concat(F.lit("https://jobs.example.edu/"), "doc_id")).alias("content"))


@query("render_digest", cte(*HEALTH_CTE, DIGEST_LINES.format(limit=V.DIGEST_LIMIT), """
body AS (SELECT day, header, n_lines, SUM(CASE WHEN included THEN 1 ELSE 0 END)::BIGINT AS n_shown,
  string_agg(CASE WHEN included THEN line || chr(10) END, '' ORDER BY pos) AS shown FROM incl GROUP BY 1, 2, 3)""") + """
SELECT CAST(day AS VARCHAR) AS day, n_shown, header || shown || CASE WHEN n_lines > n_shown THEN '另有 ' || (n_lines - n_shown) || ' 個來源，請查看網站「來源狀態」。' || chr(10) ELSE '' END
  || '已保留歷史資料；未完成檢索不代表沒有新職位。' AS content FROM body""")
def render_digest(spark, sf):
    h = health_state(spark, sf)
    return health.digest_messages(health.digest_lines(h, health.transitions(h))).select(
        day("day").alias("day"), F.col("n_shown").cast("bigint").alias("n_shown"), "content")


def slot_delay_of(ts, hour: int, minute: int, zone: str = V.TIME_ZONE):
    """Seconds since the latest daily slot at or before a UTC time, in the slot's zone."""
    local = F.from_utc_timestamp(ts, zone)
    slot = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    latest = F.when(slot > local, slot - F.expr("INTERVAL '1' DAY")).otherwise(slot)
    return F.unix_timestamp(local) - F.unix_timestamp(latest)


@query("slot_delay", """
WITH l AS (SELECT event_id, event_type, date_trunc('second', ts) + INTERVAL 8 HOUR AS t FROM events),
s AS (SELECT *, date_trunc('day', t) + INTERVAL 8 HOUR + INTERVAL 17 MINUTE AS slot FROM l)
SELECT event_id, CASE WHEN event_type <> 'click' THEN date_diff('second', CASE WHEN slot > t THEN slot - INTERVAL 1 DAY ELSE slot END, t) END AS delay_seconds FROM s""")
def slot_delay(spark, sf):
    # Only scheduled runs have a slot; a manual one (here: a click) has no delay.
    return table(spark, sf, "events").select("event_id", F.when(
        F.col("event_type") != "click", slot_delay_of(F.col("ts"), 8, 17)).alias("delay_seconds"))
