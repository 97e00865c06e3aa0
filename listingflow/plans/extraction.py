"""Extraction jobs over the page table and record projection."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.keys import stable_key
from ..functions.text import clean_text
from ..operators import pages as P
from ..registry import query
from ..sources.tables import table, text_table
from .common import sql_clean, sql_inline, sql_page_text, sql_unescape


@query("page_title_heading", f"""
SELECT page_id, {sql_inline("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
       {sql_inline("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading FROM pages""")
def page_title_heading(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", H.inline_text(H.title(F.col("html"))).alias("title"),
        H.inline_text(H.heading(F.col("html"))).alias("heading"))


LINKS = f"""
la AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
              regexp_extract_all(html, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs,
              regexp_extract_all(html, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', 2) AS texts FROM pages),
lu AS (SELECT page_id, url, origin, hrefs, texts, unnest(range(len(hrefs))) AS pos FROM la),
links AS (SELECT page_id, url, CAST(pos AS INT) AS pos, {sql_unescape("hrefs[pos + 1]")} AS href,
                 origin || {sql_unescape("hrefs[pos + 1]")} AS target, {sql_inline("texts[pos + 1]")} AS text FROM lu)
"""


@query("page_links", f"""WITH {LINKS}
SELECT page_id, pos, target, text, CASE WHEN href = '' THEN 'missing link' WHEN text = '' THEN 'missing title' ELSE '' END AS reject FROM links""")
def page_links(spark, sf):
    return P.link_rows(table(spark, sf, "pages")).select(
        "page_id", "pos", "target", "text", F.coalesce("reject", F.lit("")).alias("reject"))


@query("page_text", f"SELECT page_id, {sql_page_text('html')} AS text FROM pages")
def page_text(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", H.markup_to_text(F.col("html")).alias("text"))


_TRIMMED = "html"
for _block in ("<!--.*?-->", "<nav[^>]*>.*?</nav>", "<footer[^>]*>.*?</footer>", '<div class="ad">.*?</div>'):
    _TRIMMED = f"regexp_replace({_TRIMMED}, '(?is){_block}', '', 'g')"


@query("page_body_trim", f"""
WITH t AS (SELECT page_id, {_TRIMMED} AS kept FROM pages)
SELECT page_id, {sql_page_text("substr(kept, strpos(kept, '<article>'))")} AS body FROM t""")
def page_body_trim(spark, sf):
    return text_table(spark, sf, "pages").select(
        "page_id", H.markup_to_text(P.trim_body(F.col("html"), "<article>")).alias("body"))


@query("inline_sections", f"""
WITH two AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html || '<article>' || page_id || '<p>' || substr(html, 1, 300) || '</article>' || html ELSE html END AS html FROM pages),
a AS (SELECT page_id, flatten(list_transform(regexp_extract_all(html, '(?is)<article>(.*?)</article>', 1), lambda x: string_split(x, '<p>')[2:])) AS parts FROM two),
u AS (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM a),
t AS (SELECT page_id, CAST(pos AS INT) AS pos, {sql_inline("parts[pos]")} AS txt FROM u),
s AS (SELECT page_id, pos, trim(regexp_extract(txt, '(?s)^([^.]*)', 1)) AS heading,
             trim(regexp_extract(txt, '(?s)^[^.]*\\.(.*)$', 1)) AS body FROM t)
SELECT page_id, pos, heading, body, heading <> '' AND length(body) >= 100 AS ok,
       COUNT(*) OVER (PARTITION BY page_id, heading) > 1 AS duplicate FROM s""")
def inline_sections(spark, sf):
    # Every other page holds further articles, one of them with the sections of the first.
    more = F.concat("html", F.lit("<article>"), "page_id", F.lit("<p>"), F.substring("html", 1, 300), F.lit("</article>"), "html")
    pages = text_table(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 2 == 0, more).otherwise(F.col("html")))
    return P.sections(pages)


# Damaged variants of the pages: challenge, denial, challenge resource with and without text.
_DAMAGE = """CASE page_id % 7
  WHEN 0 THEN replace(html, '<title>', '<title>Just a moment ')
  WHEN 1 THEN replace(html, '<title>', '<title>Access Denied ')
  WHEN 2 THEN '<html><script src="/_Incapsula_Resource"></script><body class="x"> </body></html>'
  WHEN 3 THEN replace(html, '<body>', '<body><script src="/_Incapsula_Resource"></script>')
  WHEN 4 THEN '<html><body></body></html>'
  WHEN 5 THEN '<html><title>Jobs</title><body><p>' || page_id || ' soon</p></body></html>'
  ELSE html END"""


@query("page_quality", f"""
WITH d AS (SELECT page_id, lower({_DAMAGE}) AS h FROM pages), t AS (SELECT *, {sql_page_text('h')} AS txt FROM d)
SELECT page_id, CASE
  WHEN (contains(h, '_incapsula_resource') AND regexp_matches(h, '<body[^>]*>\\s*</body>'))
    OR contains(h, '<title>just a moment') THEN 'challenge'
  WHEN contains(h, '<title>access denied') THEN 'denied'
  WHEN regexp_matches(h, '<body[^>]*>\\s*</body>') OR txt = '' THEN 'empty'
  WHEN length(txt) < 100 THEN 'short' ELSE 'ok' END AS quality FROM t""")
def page_quality(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", P.quality(F.expr(_DAMAGE)).alias("quality"))


@query("explicit_empty", """
WITH c AS (SELECT page_id, len(regexp_extract_all(html, '<p><b>')) AS n_rows, contains(html, '>The<') AS notice,
                  len(regexp_extract_all(html, '<a href="/the')) AS n_conflicts FROM pages)
SELECT page_id, n_rows, notice, n_conflicts, n_rows = 0 AND notice AND n_conflicts = 0 AS explicit_empty FROM c""")
def explicit_empty(spark, sf):
    c = table(spark, sf, "pages").select(
        "page_id", F.regexp_count("html", F.lit("<p><b>")).cast("bigint").alias("n_rows"),
        F.col("html").contains(">The<").alias("notice"),
        F.regexp_count("html", F.lit('<a href="/the')).cast("bigint").alias("n_conflicts"))
    return c.withColumn("explicit_empty", P.explicit_empty(F.col("n_rows"), F.col("notice"), F.col("n_conflicts")))


def record(rows, group, source_id, title, url, reference, **values):
    """Canonical record: identity, cleaned texts, defaults where a source states nothing."""
    ref = clean_text(reference)
    defaults = {"department": F.lit(""), "employment_type": F.lit("unknown"), "posted_date": F.lit(None).cast("date"),
                "deadline": F.lit(None).cast("date"), "deadline_type": F.lit("unknown"), "deadline_raw": F.lit(""),
                "description": F.lit(""), "match_text": F.lit(""), "detail_complete": F.lit(True)}
    fields = {**defaults, **values}
    fields["description"] = clean_text(fields["description"])
    return rows.select("*", stable_key(group, ref, url).alias("id"), source_id.alias("source_id"),
                       clean_text(title).alias("title"), ref.alias("reference"), url.alias("url"),
                       *[F.coalesce(v, defaults[k]).alias(k) if k in defaults else v.alias(k) for k, v in fields.items()])


@query("record_project", f"""
WITH d AS (SELECT doc_id, source, lang, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' Ref ' || doc_id || lang END AS ref,
                  'HTTPS://Jobs.example.edu/ad/' || doc_id || '?utm_source=x&id=' || doc_id AS url FROM documents)
SELECT doc_id, substr(sha256(source || chr(0) || CASE WHEN ref <> '' THEN replace(upper(trim(ref)), ' ', '')
         ELSE 'https://jobs.example.edu/ad/' || doc_id || '?id=' || doc_id END), 1, 24) AS id,
       source AS source_id, {sql_clean("substr(text, 1, 60)")} AS title, trim(ref) AS reference, url,
       {sql_clean("text")} AS description, 'unknown' AS employment_type, 'unknown' AS deadline_type,
       CASE WHEN lang = 'en' THEN 'Office' ELSE '' END AS department, TRUE AS detail_complete FROM d""")
def record_project(spark, sf):
    d = text_table(spark, sf, "documents").withColumnRenamed("source", "src")
    ref = F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' Ref ' || doc_id || lang END")
    url = F.expr("'HTTPS://Jobs.example.edu/ad/' || doc_id || '?utm_source=x&id=' || doc_id")
    r = record(d, F.col("src"), F.col("src"), F.substring("text", 1, 60), url, ref, description=F.col("text"),
               department=F.when(F.col("lang") == "en", "Office"))
    return r.select("doc_id", "id", "source_id", "title", "reference", "url", "description", "employment_type",
                    "deadline_type", "department", "detail_complete")
