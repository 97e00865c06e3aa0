"""Scans: snapshots, dimensions, pages and payloads."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import pages as P
from ..registry import query
from ..session import work_path
from ..sources import payloads
from ..sources.tables import read_snapshot, require_version, table, text_table


@query("scan_snapshot", """
SELECT event_id, user_id, event_type, value, 1 AS version, TRUE AS version_ok FROM events""")
def scan_snapshot(spark, sf):
    # The version is a stored column; rows of two writers stand in one snapshot.
    declared = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double", "version": "int"}
    path = work_path(spark, "snapshot")
    for rest in (0, 1):
        table(spark, sf, "events").where(F.col("event_id") % 2 == rest).withColumn("version", F.lit(1)).write.mode("append").parquet(path)
    return require_version(read_snapshot(spark, path, declared), "version", 1)


REQUIRED = ["id", "grp", "name"]


@query("dim_validate", """
WITH dim AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, 'g' || s_nationkey AS grp, s_name AS name FROM supplier
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'g' || s_nationkey, s_name FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT CAST(s_suppkey + 1000000 AS VARCHAR), CASE WHEN s_nationkey < 5 THEN '' ELSE 'g' END,
                   CASE WHEN s_acctbal > 5000 THEN s_name END FROM supplier WHERE s_nationkey < 12)
SELECT id, 'duplicate id' AS problem, COUNT(*) AS n FROM dim GROUP BY id HAVING COUNT(*) > 1
UNION ALL SELECT id, 'blank grp', COUNT(*) FROM dim WHERE COALESCE(grp, '') = '' GROUP BY id
UNION ALL SELECT id, 'blank name', COUNT(*) FROM dim WHERE COALESCE(name, '') = '' GROUP BY id""")
def dim_validate(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    dim = s.select(key.cast("string").alias("id"), F.concat(F.lit("g"), "s_nationkey").alias("grp"),
                   F.col("s_name").alias("name"))
    again = s.filter("s_acctbal < 0").select(key.cast("string"), F.concat(F.lit("g"), "s_nationkey"), "s_name")
    faulty = s.filter("s_nationkey < 12").select(
        (key + 1000000).cast("string"), F.when(F.col("s_nationkey") < 5, "").otherwise("g"),
        F.when(F.col("s_acctbal") > 5000, F.col("s_name")))
    dim = dim.union(again).union(faulty)
    # One grouping finds both kinds of violation.
    per_id = dim.groupBy("id").agg(F.count("*").alias("n"), *[
        F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias("blank_" + c) for c in REQUIRED])
    found = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.struct(F.lit("duplicate id").alias("problem"), F.col("n"))),
        *[F.when(F.col("blank_" + c) > 0, F.struct(F.lit("blank " + c).alias("problem"), F.col("blank_" + c).alias("n")))
          for c in REQUIRED]))
    return per_id.select("id", F.inline(found))


def requested_ids(text: str) -> list[str]:
    """Ids of a run request in order, each once.

    Ids are made of a-z, 0-9 and "-"; any run of blanks and commas separates two of them.
    """
    allowed = set("abcdefghijklmnopqrstuvwxyz0123456789-")
    ids: dict[str, None] = {}
    for word in text.strip().replace(",", " ").split(" "):
        if not allowed.issuperset(word):
            raise ValueError(f"not a source id: {word!r}")
        if word:
            ids[word] = None
    return list(ids)


def source_subset_of(df, column: str, request: str):
    """(position, source, rows) per requested id; unknown ids stay, marked, for an error.
    An empty request means every source.  The id list reaches the scan as a filter."""
    ids = requested_ids(request)
    if not ids:
        return df.groupBy(F.col(column).alias("source_id")).agg(F.count("*").alias("n_docs")).select(
            F.lit(0).alias("position"), "source_id", F.lit(True).alias("known"), "n_docs")
    counts = df.filter(F.col(column).isin(*ids)).groupBy(F.col(column).alias("source_id")).agg(
        F.count("*").alias("n_docs"))
    wanted = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(ids, 1)], "position int, source_id string")
    return wanted.join(counts, "source_id", "left").select(
        "position", "source_id", F.col("n_docs").isNotNull().alias("known"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("source_subset", """
WITH w(position, source_id) AS (VALUES (1, 'src3'), (2, 'src1'), (3, 'nowhere'), (4, 'src0'))
SELECT position, w.source_id, COUNT(d.doc_id) > 0 AS known, COUNT(d.doc_id) AS n_docs
FROM w LEFT JOIN documents d ON d.source = w.source_id GROUP BY 1, 2""")
def source_subset(spark, sf):
    return source_subset_of(table(spark, sf, "documents"), "source", "src3 src1,src3, nowhere src0")


@query("page_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def page_scan(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


def listing_payloads(spark, sf):
    """Documents as JSON listing pages: one requisition per line."""
    rows = F.transform(F.split("text", "\n"), lambda t, i: F.struct(
        F.concat_ws("-", F.col("doc_id"), i).alias("id"), t.alias("title")))
    return text_table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(
        F.when(F.col("lang") == "de", "Busy").otherwise("Success").alias("status"),
        F.struct(F.size(F.split("text", "\n")).alias("totalCount"), rows.alias("requisitions")).alias("data"))).alias("payload"))


@query("json_listing", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE lang <> 'de'),
u AS (SELECT doc_id, len(ls) AS declared_total, ls, unnest(range(len(ls))) AS pos FROM l)
SELECT doc_id, CAST(declared_total AS BIGINT) AS declared_total, CAST(pos AS INT) AS pos,
       doc_id || '-' || pos AS reference, ls[pos + 1] AS title FROM u""")
def json_listing(spark, sf):
    rows, _ = payloads.listing_rows(listing_payloads(spark, sf), "payload", "doc_id")
    return rows


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", payloads.variant_number(F.col("props"), "$.k").alias("k"))


@query("json_detail_merge", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, CAST(doc_id AS VARCHAR) AS key,
       array_to_string(list_filter(ls, lambda x: x <> '' AND NOT contains(x, '|')), chr(10)) AS body,
       len(list_filter(ls, lambda x: contains(x, '|'))) > 0 AS rejected FROM l""")
def json_detail_merge(spark, sf):
    kind = lambda t: F.when(t == "", "CustomSpace").when(t.contains("|"), "CustomTable").otherwise("CustomText")
    d = text_table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(
        F.lit("job").alias("category"), F.col("doc_id").cast("string").alias("key"),
        F.transform(F.split("text", "\n"), lambda t: F.struct(
            kind(t).alias("type"), F.struct(t.alias("text")).alias("content"))).alias("components"))).alias("payload"))
    return d.select("doc_id", payloads.merged_body(F.col("payload")).alias("m")).select(
        "doc_id", "m.key", "m.body", F.col("m.unknown").alias("rejected"))


@query("embedded_literal", """
SELECT page_id, CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS BIGINT) AS tracked,
       regexp_extract(html, 'var t="([^"]*)"', 1) AS literal,
       len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS n_pairs,
       COALESCE(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)', 2)[1], '') AS first_value FROM pages""")
def embedded_literal(spark, sf):
    item = r'<li><a href="([^"]*)">([^<]*)'
    keys = F.regexp_extract_all("html", F.lit(item), F.lit(1))
    values = F.regexp_extract_all("html", F.lit(item), F.lit(2))
    p = table(spark, sf, "pages").select(
        "page_id", F.try_element_at(P.script_literals(F.col("html"), "track"), F.lit(1)).alias("tracked"),
        P.script_string(F.col("html"), "t").alias("literal"), P.zipped_literals(keys, values).alias("pairs"))
    return p.select("page_id", "tracked", "literal", F.size("pairs").cast("bigint").alias("n_pairs"),
                    F.coalesce(F.try_element_at("pairs", F.lit(1))["v"], F.lit("")).alias("first_value"))


def _with_script(pages):
    """Pages with a script of nested literals: brackets, quotes and backslashes inside strings, several per page, some broken."""
    n = F.col("page_id").cast("string")
    first = F.concat(F.lit("<script>window.df_option_"), n, F.lit(' = {"source":"https://x/'), n,
                     F.lit(r'.pdf","o":{"a":[1,{"b":"]}\"{\\"}],"n":'), (F.col("page_id") % 7).cast("string"), F.lit("}};rows="))
    kind = F.col("page_id") % 4
    second = (F.when(kind == 0, '[[1,"]"],[2,"["]]').when(kind == 1, "[]")
              .when(kind == 2, F.concat(F.lit('[{"k":"'), n, F.lit('"}'))).otherwise("{not data}"))
    return pages.select("page_id", F.concat("html", first, second, F.lit(';df_option_x={"source":null}</script>')).alias("html"))


@query("script_data", """
WITH v AS (SELECT page_id, UNNEST([
  struct_pack(pos := 0, name := 'window.df_option_' || page_id, source := 'https://x/' || page_id || '.pdf', n := CAST(page_id % 7 AS VARCHAR), n_items := 2, reject := ''),
  struct_pack(pos := 1, name := 'rows', source := NULL, n := NULL, n_items := CASE page_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 END,
    reject := CASE page_id % 4 WHEN 2 THEN 'literal does not close' WHEN 3 THEN 'literal is no data' ELSE '' END),
  struct_pack(pos := 2, name := 'df_option_x', source := NULL, n := NULL, n_items := NULL, reject := '')]) AS x FROM pages)
SELECT page_id, x.pos, x.name, x.source, x.n, CAST(x.n_items AS INT) AS n_items, x.reject FROM v""")
def script_data(spark, sf):
    """Data literals that page scripts assign, nested ones whole."""
    pages = _with_script(table(spark, sf, "pages"))
    found = P.assigned_literals(pages, r"(?:window\.)?df_option_\w+|rows")
    at = lambda path: F.get_json_object("literal", path)
    items = F.coalesce(F.json_array_length(at("$.o.a")), F.json_array_length("literal"))
    return found.select("page_id", "pos", "name", *[F.when(F.col("reject").isNull(), v).alias(n) for n, v in (
        ("source", at("$.source")), ("n", at("$.o.n")), ("n_items", items))], F.coalesce("reject", F.lit("")).alias("reject"))
