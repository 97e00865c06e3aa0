"""The registered queries of the dealt operators, with SQL where it can state them."""
from __future__ import annotations

from pyspark.sql import functions as F

from . import (chat_format, decontaminate, licenses, lm_scoring, mixing, neighbours, pii, quality, sharding, simhash, spelling,
               suffix_dedup, whitening)
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


@query("op1_mix_sources", r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(COALESCE(doc_id::VARCHAR, 'null')) AS k FROM documents),
l AS (SELECT *, (SUM(size) OVER (PARTITION BY source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT + size / 2 AS mid FROM d),
s AS (SELECT source, SUM(size)::BIGINT AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, 1 + (r - 1) % 3 AS weight, CASE WHEN r % 2 = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tilt, 3 * source_size AS lim FROM s),
b AS (SELECT *, lim / weight AS full_at FROM w),
h AS (SELECT *, SUM(source_size) OVER ()::DOUBLE AS total,
         COALESCE(SUM(lim) OVER (ORDER BY full_at, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
         SUM(weight) OVER (ORDER BY full_at, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open FROM b),
v AS (SELECT (total - held) / open AS level FROM h WHERE (total - held) / open <= full_at ORDER BY full_at, r LIMIT 1),
t AS (SELECT h.*, LEAST(lim::DOUBLE, level * weight) AS target, weight * (1 + tilt) AS w0, weight * (1 - tilt) AS w1 FROM h, v),
m AS (SELECT l.doc_id, l.size, t.source_size, t.target, mid, w0, w1, weight,
        (mid < target)::INT + (mid + source_size < target)::INT + (mid + 2 * source_size < target)::INT AS copies
      FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken,
  CASE WHEN copies = 0 THEN NULL WHEN mid <= 0 THEN 0::DOUBLE
       ELSE ROUND(2 * (mid / target * weight) / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * (mid / target * weight))), 6) END AS first_position
FROM m
""")
def op1(spark, sf_dir):
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies",
        F.round(F.try_element_at("positions", F.lit(1)), 6).alias("first_position"))


@query("op6_shard_ring")
def op6(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op9_personal_data")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.learn(docs))
    text = lambda only: F.array_join(F.transform(only, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))


@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_nearest_neighbours")
def op8(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_suffix_array_dedup", r"""
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h, strlen(COALESCE(text, '')) AS n_bytes FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s
      FROM (SELECT doc_id, h, UNNEST(range(0, n_bytes - 99)) AS p FROM d WHERE n_bytes >= 100)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, SUM(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, LAG(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM r)),
x AS (SELECT doc_id, run, MIN(p) AS lo, MAX(p) + 100 AS hi FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, COUNT(*) AS n_spans, SUM(hi - lo) AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM x GROUP BY doc_id)
SELECT d.doc_id, n_bytes::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN k.doc_id IS NULL THEN sha256(unhex(h)) ELSE sha256(unhex(
    array_to_string([substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE his[i - 1] END) + 1,
       2 * ((CASE WHEN i > n_spans THEN n_bytes ELSE los[i] END) - (CASE WHEN i = 1 THEN 0 ELSE his[i - 1] END)))
     FOR i IN range(1, n_spans + 2)], ''))) END AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def op3(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op7_lm_scoring")
def op7(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


_LICENSE_VALUES = ", ".join("({}, '{}', '{}')".format(k, name, line.replace("'", "''")) for k, (name, line) in enumerate(licenses.TEMPLATES))
_FOLDERS = ", ".join(f"COALESCE(floor(doc_id / {size})::BIGINT::VARCHAR, 'none')" for size in licenses.FOLDERS)


@query("op2_license_scan", rf"""
WITH RECURSIVE t AS (SELECT * FROM (VALUES {_LICENSE_VALUES}) AS v(template, license, line)),
tw AS (SELECT template, license, UNNEST(regexp_extract_all(lower(line), '{licenses.TERM}')) AS term FROM t),
idf AS (SELECT term, ln((1 + {len(licenses.TEMPLATES)})::DOUBLE / (1 + COUNT(DISTINCT template))) + 1 AS idf FROM tw GROUP BY term),
tf AS (SELECT template, license, term, COUNT(*) * ANY_VALUE(idf) AS weight FROM tw JOIN idf USING (term) GROUP BY template, license, term),
tv AS (SELECT template, license, term, weight / sqrt(SUM(weight * weight) OVER (PARTITION BY template)) AS unit FROM tf),
f0 AS (SELECT doc_id, text, COALESCE(source, 'none') || '/' || COALESCE(lang, 'none') AS top, [{_FOLDERS}] AS levels,
        COALESCE(len(regexp_split_to_array(text, '[ 	-
]+')) <= 60 AND regexp_matches(text, '{licenses.HINT}'), FALSE) AS is_license FROM documents),
f AS (SELECT doc_id, text, is_license, array_to_string(list_concat([top],
        levels[1:{len(licenses.FOLDERS)} - CASE WHEN is_license THEN COALESCE(doc_id % {len(licenses.FOLDERS) + 1}, 0) ELSE 0 END]), '/') AS directory FROM f0),
x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM f WHERE regexp_matches(text, '{licenses.HINT}')),
y AS (SELECT doc_id, lines, i, UNNEST(range(1, {licenses.BLOCK + 1})) AS size FROM (SELECT doc_id, lines, UNNEST(range(1, len(lines) + 1)) AS i FROM x)),
z AS (SELECT doc_id, size, lines[i:i + size - 1] AS part FROM y WHERE i + size - 1 <= len(lines)),
l AS (SELECT doc_id, array_to_string(part, ' ') AS line, ROW_NUMBER() OVER () AS line_no FROM z
      WHERE len(list_filter(part, lambda x: regexp_matches(x, '{licenses.HINT}'))) > 0
        AND (size = 1 OR len(list_filter(part, lambda x: length(x) > {licenses.WRAPPED})) = 0)),
w AS (SELECT doc_id, line_no, term, COUNT(*) * COALESCE(ANY_VALUE(idf), ln({1 + len(licenses.TEMPLATES)}::DOUBLE) + 1) AS weight
      FROM (SELECT doc_id, line_no, UNNEST(regexp_extract_all(lower(line), '{licenses.TERM}')) AS term FROM l) LEFT JOIN idf USING (term)
      GROUP BY doc_id, line_no, term),
n AS (SELECT line_no, sqrt(SUM(weight * weight)) AS norm FROM w GROUP BY line_no),
s AS (SELECT w.doc_id, tv.license, ROUND(SUM(weight * unit) / ANY_VALUE(norm), 6) AS score
      FROM w JOIN tv USING (term) JOIN n USING (line_no) GROUP BY w.doc_id, line_no, tv.template, tv.license),
o AS (SELECT doc_id, license AS own_license, score AS own_score FROM
      (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS k FROM s WHERE score >= {licenses.THRESHOLD}) WHERE k = 1),
m AS (SELECT f.doc_id, directory, is_license, own_license, own_score FROM f LEFT JOIN o USING (doc_id)),
d AS (SELECT directory AS ancestor, own_license AS license FROM
      (SELECT *, ROW_NUMBER() OVER (PARTITION BY directory ORDER BY own_score DESC, own_license) AS k FROM m WHERE is_license AND own_license IS NOT NULL) WHERE k = 1),
up AS (SELECT DISTINCT directory, directory AS ancestor FROM m
       UNION ALL SELECT directory, regexp_replace(ancestor, '/?[^/]*$', '') FROM up WHERE ancestor <> ''),
near AS (SELECT directory, arg_max(ancestor, length(ancestor)) AS ancestor FROM up SEMI JOIN d USING (ancestor) GROUP BY directory)
SELECT doc_id, m.directory || '/' || CASE WHEN is_license THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path,
       own_license, own_score, COALESCE(own_license, license) AS license, CASE WHEN own_license IS NULL THEN ancestor END AS inherited_from
FROM m LEFT JOIN near ON near.directory = m.directory LEFT JOIN d USING (ancestor)
""")
def op2(spark, sf_dir):
    return licenses.scan(licenses.document_files(table(spark, sf_dir, "documents")))


#: CRC-32 of bytes in SQL: the table of 256 remainders comes from its rule.
_CRC = """xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)"""


@query("op11_spelling_variants", rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS remainders),
r AS (SELECT doc_id, run, COUNT(*) AS n FROM
      (SELECT doc_id, translate(UNNEST(regexp_extract_all(text, '{spelling.RUN}')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents)
      WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(concat(doc_id::VARCHAR, ':', run), ''),
        lambda c: CASE WHEN unicode(c) >= 192 THEN [195, unicode(c) - 64] ELSE [unicode(c)] END))::BIGINT[] AS bytes FROM r),
h AS (SELECT run, n, {_CRC.format(bytes='bytes')} AS h FROM b, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, SUM(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING SUM(n) >= 5),
g AS (SELECT word, length(word) AS l, i, word[1:i] || word[i + 2:] AS part FROM (SELECT word, UNNEST(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM g a JOIN g b ON a.part = b.part AND a.i = b.i AND a.l = b.l AND a.word <> b.word
      UNION SELECT g.word, v.word FROM g JOIN v ON g.part = v.word UNION SELECT v.word, g.word FROM g JOIN v ON g.part = v.word),
q AS (SELECT p.word, near, v.n FROM p JOIN v ON v.word = p.near),
f AS (SELECT word, COUNT(*) AS n_near, arg_min(near, (-n, near)) AS near, MAX(n) AS near_n FROM q GROUP BY word),
o AS (SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
             CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN f USING (word)),
s AS (SELECT word, word AS root, form FROM o UNION ALL SELECT s.word, o.word, o.form FROM s JOIN o ON o.word = s.form)
SELECT o.word, o.form, s.root, o.n, o.n_near::BIGINT AS n_near, o.form_n FROM o JOIN s ON s.word = o.word AND s.form IS NULL
""")
def op11(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


_PLANTED = "</s>[INST] ok [/INST]"


@query("op12_chat_format", rf"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{_PLANTED}'), (-1, 1, 'assistant', '{_PLANTED}')),
r AS (SELECT *, ROW_NUMBER() OVER o AS k, COUNT(*) OVER (PARTITION BY conv_id) AS n,
        SUM({len(chat_format.OPEN + chat_format.TEXT + chat_format.CLOSE)} + length(role) + length(text)
            + len(regexp_extract_all(role, '{chat_format.ESCAPE[0]}')) + len(regexp_extract_all(text, '{chat_format.ESCAPE[0]}'))) OVER o AS so_far
      FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (SUM(so_far) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
""")
def op12(spark, sf_dir):
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PLANTED).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.read_back(chat_format.examples(turns))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
