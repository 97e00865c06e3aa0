"""Scalar semantics: text, dates, keys, rules, searches, robots."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from listingflow.functions import dates, html, keys, rules, text
from listingflow.operators import health, pages, robots, search
from listingflow.plans.scans import requested_ids
from listingflow.sources.tables import SnapshotShapeError, read_snapshot, require_version


def value(spark, make, *args):
    schema = ", ".join(f"c{i} string" for i in range(len(args)))
    df = spark.createDataFrame([args], schema)
    return df.select(make(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize("raw, day", [
    ("30+ days ago", None), ("job reference 260905001", None), ("4-Sep-2026", "2026-09-04"),
    ("2026年9月4日", "2026-09-04"), ("2026/9/4", "2026-09-04"), ("September 4th, 2026", "2026-09-04"),
    ("Sept 4 2026", "2026-09-04"), ("31 February 2026 or March 1, 2026", "2026-03-01"), ("4/9/2026", None),
    ("4 Foo 2026", None), ("12026-01-01", None), (None, None), ("2026-02-30, 1 March 2026", "2026-03-01")])
def test_parse_date(spark, raw, day):
    got = value(spark, dates.parse_date, raw)
    assert (got.isoformat() if got else None) == day


def test_dates_with_zone_and_locale(spark):
    assert value(spark, dates.local_date, "2026-09-04T23:00:00Z") == dt.date(2026, 9, 5)
    assert value(spark, dates.local_date, "2026-09-04") == dt.date(2026, 9, 4)
    assert value(spark, lambda c: dates.parse_date_locale(c, F.lit("DMY")), "‎4.9.2026 ") == dt.date(2026, 9, 4)
    assert value(spark, lambda c: dates.parse_date_locale(c, F.lit(None).cast("string")), "4/9/2026") is None
    assert value(spark, dates.feed_stamp_utc, "Fri Sep 04 23:00:00 UTC 2026") == dt.date(2026, 9, 5)
    assert value(spark, dates.feed_date_mdy, "9/4/2026") == dt.date(2026, 9, 4)


@pytest.mark.parametrize("raw, kind, day", [
    ("Initial screening: 1 September 2026", "review", "2026-09-01"),
    ("Closing date: Until the post is filled", "until-filled", None),
    ("Closing date: 10 September 2026 or until filled, whichever is earlier", "closing", "2026-09-10"),
    ("Intro\n\nClosing date:\n10 September 2026", "closing", "2026-09-10"),
    ("Review of applications starts 1 May 2026\nongoing", "review", "2026-05-01"),
    ("額滿即止", "until-filled", None), ("", "unknown", None)])
def test_deadline(spark, raw, kind, day):
    got = value(spark, dates.deadline_from, raw)
    assert got["deadline_type"] == kind
    assert (got["deadline"].isoformat() if got["deadline"] else None) == day


def test_text_cleaning(spark):
    assert value(spark, text.clean_text, " a\t  b \r\n\r\n  c  \x0b d") == "a b\nc\nd"
    assert value(spark, text.normalize_text, "Ｐａｒｔ–Time　ﬁne") == "parttime fine"
    assert value(spark, text.safe_cell, " =1+1") == "' =1+1"
    assert value(spark, text.csv_cell, 'a,"b"') == '"a,""b"""'
    assert value(spark, text.csv_cell, "=1+1") == '"\'=1+1"'
    assert value(spark, text.safe_link, "http://a.org/x") == ""
    assert value(spark, html.unescape, "&eacute;&#x4e2d;&amp;lt;&apos;") == "é中&lt;'"
    assert value(spark, html.markup_to_text, "<p>a<b>b</b><br>c</p><script>x='</p>'</script><li>d</li>") == "a b\nc\nd"


def test_bounded_terms(spark):
    hit = lambda raw, term, **k: value(spark, lambda c: text.contains_term(text.normalize_text(c), term, **k), raw)
    assert not hit("Chair in Nursing", "AI") and hit("Teach AI.", "AI") and hit("講授批判思考課", "批判思考")
    assert not hit("Lecturers", "lecturer") and hit("Lecturers", "lecturer", plural=True)
    assert hit("Part-time", "parttime") and not hit("anything", "")


@pytest.mark.parametrize("title, role", [
    ("Adjunct Faculty", "lecturer"), ("Adjunct Research Associate", "other"), ("Teaching Fellows", "lecturer"),
    ("導師", "tutor"), ("Instructor II", "instructor"), ("Lecturership", "other")])
def test_roles(spark, title, role):
    assert value(spark, rules.role_of, title) == role


@pytest.mark.parametrize("title, body, kind", [
    ("Part-time Lecturer", "", "part-time"), ("Lecturer (Part-time or Full-time)", "", "mixed"),
    ("Lecturer for Part-time Programmes", "", "unknown"), ("Tutor, hourly paid", "", "hourly"),
    ("Lecturer, full-time degree programmes", "", "unknown"), ("Lecturer", "appointed on a part-time basis", "part-time"),
    ("Lecturer", "Remuneration: hourly rate of 900", "hourly"), ("Lecturer", "part-time students welcome", "unknown")])
def test_employment(spark, title, body, kind):
    df = spark.createDataFrame([(title, body)], "title string, body string")
    assert rules.with_employment(df, F.col("title"), None, F.col("body")).first()["employment_type"] == kind


def evaluate(spark, title, description, employment="part-time"):
    df = spark.createDataFrame([(title, description, employment)], "title string, description string, kind string")
    df = rules.with_subject_hits(df, rules.subject_text(F.col("title"), F.lit(""), F.lit(""), F.col("description")))
    df = df.withColumn("role", rules.role_of(F.col("title")))
    score = rules.score_of(F.col("hits"), F.col("role"), F.col("kind"))
    return df.select(score.alias("score"), rules.is_match(
        F.col("hits"), score, F.col("role"), F.col("kind"), F.lit("s"), F.col("description")).alias("matches"), "hits").first()


def test_matching(spark):
    good = evaluate(spark, "Part-time Lecturer in Philosophy", "Teach philosophy and critical thinking skills to students.")
    assert good["matches"] and good["score"] == 85
    assert "critical-thinking" in [h["subject"] for h in good["hits"]]
    phd = ("Applicants should possess a Doctor of Philosophy or Master of Philosophy.\nThe University is committed to equality, "
           "ethics and diversity.\nApplicants should have strong critical thinking skills.")
    assert not evaluate(spark, "Part-time Lecturer in Nursing", phd)["matches"]
    assert not evaluate(spark, "Part-time Lecturer in AI", "Teach machine learning, AI and deep learning.")["matches"]
    assert not evaluate(spark, "Lecturer in AI literacy", "Teach AI literacy.", "full-time")["matches"]
    split = evaluate(spark, "Tutor", "teach critical\nthinking")["hits"][0]
    assert split["snippet"] == "critical thinking"


def test_keys(spark):
    url = "HTTPS://Example.EDU/a?utm_x=1&b=2&lang=en&a=&c=x%20y#f"
    assert value(spark, keys.canonical_url, url) == "https://example.edu/a?a=&b=2&c=x+y#f"
    key = lambda ref, u: value(spark, lambda g, r, w: keys.stable_key(g, r, w), "g", ref, u)
    assert key("ab 1", "u1") == key("AB1", "u2") and key("", "https://a/x?utm_a=1") == key("", "HTTPS://A/x")
    join = lambda base, href: value(spark, keys.join_url, base, href)
    assert join("https://a.org/x/y?q=1", "../z?w#f") == "https://a.org/z?w#f"
    assert join("https://a.org/x/y?q=1", "#f") == "https://a.org/x/y?q=1#f"
    assert join("https://a.org", "b") == "https://a.org/b" and join("https://a.org/x", "//b.org/c") == "https://b.org/c"


def test_robots(spark):
    def allowed(rules_, *paths, agent="bot"):
        r = spark.createDataFrame([("s",) + x for x in rules_], "site string, agent string, allow boolean, pattern string")
        p = spark.createDataFrame([("s", "https://e.org" + x) for x in paths], "site string, url string")
        got = {x["url"][13:]: x["allowed"] for x in robots.can_fetch(p, r, agent).collect()}
        return [got[x] for x in paths]

    star = [("*", False, "/private"), ("*", True, "/private/public"), ("*", False, "/*?secret="), ("*", False, "/closed$")]
    assert allowed(star, "/private/data", "/private/public/jobs", "/jobs?secret=1", "/closed", "/closed/jobs") == [
        False, True, False, False, True]
    merged = [("*", False, "/"), ("bot", False, "/jobs"), ("Bot", True, "/jobs")]
    assert allowed(merged, "/jobs", "/else") == [True, True]
    assert allowed([("*", False, "/caf%C3%A9")], "/café", "/cafe") == [False, True]


ADS = [("a", "a", "Part-time Lecturers in Philosophy", "Humanities", "Teach ethics and AI literacy.", "part-time", "open",
        dt.date(2026, 9, 4), dt.datetime(2026, 9, 5, 0, 17), "closing", dt.date(2026, 9, 10)),
       ("b", "b", "Tutor", "Computing", "Teach machine learning.", "full-time", "open",
        None, dt.datetime(2026, 9, 4, 18, 0), "review", dt.date(2026, 8, 30))]
SCHEMA = ("id string, source_id string, title string, department string, description string, employment_type string, status string, "
          "posted_date date, first_seen timestamp_ntz, deadline_type string, deadline date")


CRITERIA = [
    ({"query": "philosophy, parttime, lecturer"}, "a"), ({"query": "philosophy tutor", "mode": "OR"}, "ab"),
    ({"query": "philosophy tutor -fulltime", "mode": "OR"}, "a"), ({"query": "philosophy", "exclude": '"AI literacy"'}, ""),
    ({"institutions": ()}, ""), ({"institutions": ("b",), "query": "philosophy"}, ""),
    ({"date_from": "2026-09-05", "date_to": "2026-09-05"}, "b"),
    ({"date_basis": "first_seen", "date_from": "2026-09-05", "date_to": "2026-09-05"}, "ab"),
    ({"date_basis": "deadline", "date_from": "2026-01-01"}, "a"),
    ({"preset_enabled": True, "subject_keywords": "philosophy, AI literacy", "role_keywords": "lecturer, instructor",
      "part_time_only": True}, "a"),
    ({"preset_enabled": True, "preset_exclude": "machine learning，護理\nAI literacy"}, ""),
    ({"preset_enabled": False, "preset_exclude": "machine learning"}, "ab"),
    ({"query": '-"machine learning"'}, "a")]


def test_saved_searches(spark):
    table = search.searches_table(spark, [search.SavedSearch(str(n), **c) for n, (c, _) in enumerate(CRITERIA)])
    found = search.match_saved_searches(spark.createDataFrame(ADS, SCHEMA), table, F.lit("2026-09-05").cast("date"))
    got = {(r["search"], r["id"]) for r in found.collect()}
    assert got == {(str(n), i) for n, (_, ids) in enumerate(CRITERIA) for i in ids}


def test_query_text(spark):
    df = spark.createDataFrame([('philosophy，"AI literacy" -"machine learning"', "AI literacy, 哲學\ncritical thinking"),
                                ('"unfinished', "")], "q string, k string")
    rows = df.select(search.parse_query(F.col("q")).alias("q"), search.keyword_terms(F.col("k")).alias("k")).collect()
    assert (rows[0].q.positive, rows[0].q.negative, rows[0].q.unclosed_quote) == (
        ["philosophy", "AI literacy"], ["machine learning"], False)
    assert rows[1].q.unclosed_quote and rows[0].k == ["AI literacy", "哲學", "critical thinking"]


FORMS = [
    ("tutors", True), ("tutor", True), ("tut", False), ("café", True), ("c++", True), ("通識", True), ('"a.b"', False), ("part-time", True),
    ('"teaches in"', True), ("teache", True), ("teach", False), ("r&d", True), ("-tutor", False), ("-absent", True), ('"\\e x"', False)]


def test_every_form_of_term_finds_its_records(spark):
    """Terms meet records by pieces of text; none of their forms may be lost on the way."""
    row = dict(zip([c.strip().split()[0] for c in SCHEMA.split(",")], ADS[0]))
    row |= {"title": "Part", "department": "time", "description": "Tutors at the CAFÉ teache\u2010s in C++, R&D: 通識課; aXb; teaches in\nteams"}
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    table = search.searches_table(spark, [search.SavedSearch(q, query=q, recent_days="all") for q, _ in FORMS])
    found = search.match_saved_searches(df, table, F.lit("2026-09-05").cast("date"))
    assert {r["search"] for r in found.collect()} == {q for q, hit in FORMS if hit}


def test_plan_does_not_grow_with_searches(spark):
    df = spark.createDataFrame(ADS, SCHEMA)
    sizes = []
    for n in (2, 200):
        table = spark.range(n).select(F.concat(F.lit("s"), "id").alias("name"), *[
            F.lit(v).cast(t).alias(c) for c, t, v in (
                ("institutions", "array<string>", None), ("status", "string", "all"), ("date_basis", "string", "effective"),
                ("recent_days", "string", "all"), ("date_from", "string", ""), ("date_to", "string", ""), ("mode", "string", "AND"),
                ("query", "string", "philosophy"), ("exclude", "string", ""), ("preset_enabled", "boolean", False),
                ("subject_keywords", "string", ""), ("role_keywords", "string", ""), ("preset_exclude", "string", ""),
                ("part_time_only", "boolean", False))])
        found = search.match_saved_searches(df, table, F.lit("2026-09-05").cast("date"))
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_source_requests():
    assert requested_ids(" b a,b ") == ["b", "a"] and requested_ids("") == []
    with pytest.raises(ValueError):
        requested_ids("a; rm")


def test_source_labels(spark):
    base = dict(enabled=True, status="partial", capability="list_only", severity="warning", listing=True,
                seen="2026-11-16 12:00:00", success=None)

    def label(**change):
        row = {**base, **change}
        df = spark.createDataFrame([tuple(row.values())], "enabled boolean, status string, capability string, severity string, "
                                   "listing boolean, seen string, success string")
        return df.select(health.state_label(
            *[F.col(c) for c in ("enabled", "status", "capability", "severity", "listing")], F.col("seen").cast("timestamp"),
            F.col("success").cast("timestamp"), F.lit("2026-11-17 00:00:00").cast("timestamp")).alias("v")).first()["v"]

    assert label() == "limited" and label(severity="error", listing=False) == "error"
    assert label(capability="manual") == "manual" and label(capability="pending") == "pending"
    assert label(seen="2026-11-14 00:00:00") == "stale"
    assert label(status="ok", capability=None, severity=None, listing=None, seen=None, success="2026-11-14 00:00:00") == "stale"
    assert label(capability=None, severity=None, listing=None, seen=None) == "partial"


def test_snapshot_of_another_shape_is_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([(1, "x")], "id int, name string").write.parquet(path)
    assert read_snapshot(spark, path, {"id": "int"}).columns == ["id"]
    with pytest.raises(SnapshotShapeError):
        read_snapshot(spark, path, {"id": "bigint"})
    with pytest.raises(Exception, match="unexpected snapshot version"):
        require_version(spark.read.parquet(path), "id", 2).collect()


def test_explicit_empty(spark):
    df = spark.createDataFrame([(0, True, 0), (0, True, 1), (0, False, 0), (3, True, 0)], "n int, notice boolean, bad int")
    rows = df.select(pages.explicit_empty(F.col("n"), F.col("notice"), F.col("bad")).alias("v")).collect()
    assert [r["v"] for r in rows] == [True, False, False, False]


def test_a_parsed_query_is_computed_once(spark):
    from listingflow.operators import search
    rows = spark.createDataFrame([('a -b "c d" -"e f",--g "h',), (None,), ("",), ('-" " - ""',)], "q string")
    parsed = rows.select(search.parse_query(F.concat("q", F.lit(""))).alias("p")).select("p.positive", "p.negative", "p.unclosed_quote")
    assert [tuple(r) for r in parsed.collect()] == [
        (["a", "c d", "h"], ["b", "e f", "-g"], True), (None, None, None), ([], [], False), ([], [], False)]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count(r"[^\s") == 1  # the pattern of the tokens


def test_payload_pages_are_read_once(spark):
    from listingflow.sources.payloads import proved_listings
    page = lambda status, total, *ids: '{"status":"%s","data":{"totalCount":%d,"requisitions":[%s]}}' % (
        status, total, ",".join('{"id":"%s","title":""}' % i for i in ids))
    rows = [(1, 1, page("Success", 3, "a", "b")), (1, 2, page("Success", 3, "c")), (2, 1, page("Busy", 2, "a", "b")),
            (3, 1, page("Success", 3, "a", "b")), (3, 2, page("Success", 3, "a")), (4, 1, page("Busy", 1)), (4, 2, page("Success", 3, "c")),
            (None, 1, page("Busy", 1)), (None, 2, page("Success", 1, "a")), (5, 1, page("Success", 0))]
    e = proved_listings(spark.createDataFrame(rows, "listing_id int, page int, payload string"), "payload", F.lit(2).cast("bigint"))
    got = {r.listing_id: (r.n_rows, r.n_pages, r.reasons, r.whole) for r in e.collect()}
    assert got == {
        1: (3, 2, [], True), 2: (None, None, ["page refused"], False),
        3: (3, 2, ["id repeated across pages", "count differs from total"], False),
        4: (1, 1, ["pages missing", "count differs from total", "page size inconsistent", "page refused"], False),
        None: (None, None, ["page refused"], False)}
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("from_json") == 1


def test_terms_are_looked_for_by_shared_pieces_and_plain_characters(spark):
    """score_max: a text is scanned once for the piece of several terms, and a pattern begins with its term."""
    terms = ["philosophy", "philosophical", "moral philosophy", "ethics", "AI ethics", "", "通識", "c++"]
    pieces = text.shared_pieces(map(text.normalize_term, terms))
    assert all(piece in term for term, piece in pieces.items()) and len(pieces) == 7 and len(set(pieces.values())) == 4
    assert all(text.term_regex(t).startswith(t) for t in ("philosophy", "通識"))
    df = spark.createDataFrame([("Ethics of AI\nphilosophy",), ("bioethics, ethics2",), ("part\u2013\ntime Ethics",), (None,)], "t string")
    hits = rules.with_subject_hits(df, F.coalesce("t", F.lit("")))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert [[(h.subject, h.terms, h.snippet) for h in r.hits] for r in hits.collect()] == [
        [("philosophy", ["philosophy"], "philosophy"), ("ethics", ["ethics"], "Ethics of AI"), ("ai-humanities", ["ethics of AI"], "Ethics of AI")],
        [], [("ethics", ["ethics"], "time Ethics")], []]
    assert plan.count("AS _held_") == len(set(text.shared_pieces(
        text.normalize_term(t) for *_, ts in rules.V.SUBJECTS for t in ts).values())) < 20


def test_bounded_terms_as_stated_one_by_one(spark):
    """The pattern that begins with the term finds what the statement of the rule finds."""
    import itertools
    import re
    around = ["", " ", "a", "s", "s.", "ss", "9", "-", "é", "ai", "\n"]
    texts = [b + t + a for b, t, a in itertools.product(around, ("ai", "c++", "通識", "aiai", "ai ai"), around)]
    for term in ("ai", "c++", "通識", "ai ai"):
        begins, ends = (r"(\A|[^a-z0-9])" if term[0].isascii() else ""), (r"([^a-z0-9]|\Z)" if term[-1] in "ai" else "")
        for plural in (False, True):
            stated = re.compile(begins + re.escape(term) + ("s?" if plural and term[-1] in "ai" else "") + ends)
            rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.contains_term(F.col("t"), term, plural).alias("hit"))
            assert [r.t for r in rows.collect() if r.hit != bool(stated.search(r.t))] == []


def test_every_blank_folds_to_one(spark):
    """normalize_text: runs of all white space become one blank, and nothing else does."""
    blanks = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    df = spark.range(1, 0x3100).select("id", F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), "UTF-8"), "UTF-8").alias("c"))
    folded = df.select("id", text.fold_text(F.concat(F.lit("x"), "c", F.lit("y"))).alias("one"),
                       text.fold_text(F.concat(F.lit("x "), "c", "c", F.lit("y"))).alias("run")).collect()
    assert [r.id for r in folded if r.one == "x y"] == blanks and [r.id for r in folded if r.run == "x y"] == blanks


def test_an_exclusion_folds_only_texts_that_may_hold_it(spark):
    """score_max: words in either form exclude; a text without their longest word is never folded."""
    rows = spark.createDataFrame([("SEMINARS",), ("seminars2",), ("part\u2013\ntime",), ("Ｓｅｍｉｎａｒｓ here",), (None,)], "t string")
    ok = rules.is_match(F.array(F.lit(1)), F.lit(100), F.lit("tutor"), F.lit("hourly"), F.lit("a"), F.col("t"), exclude=["seminars", "part-time"])
    assert [r.m for r in rows.select(ok.alias("m")).collect()] == [False, True, False, False, True]
    only = rules.is_match(F.array(F.lit(1)), F.lit(100), F.lit("tutor"), F.lit("hourly"), F.lit("a"), F.col("t"), exclude=["seminars"])
    plan = rows.select(only.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index(", seminars)") < plan.index("regexp_replace")


def test_patterns_of_searched_terms_begin_with_the_term(spark):
    """saved_search_match: Java leaps through a text only for a pattern that begins with plain characters."""
    table = search.searches_table(spark, [search.SavedSearch("s", query='ai c++ "r&d x" 通識 9z9')])
    terms = search.search_terms(table).select("term", "pattern")
    patterns = {r.term: r.pattern for r in terms.collect()}
    assert set(patterns) == {"ai", "c++", "r&d x", "通識", "9z9"}
    assert all(p.startswith(rf"\Q{t}\E") for t, p in patterns.items())
    texts = {"ai": {"ai", "x ais", "ai."}, "c++": {"c++", " c++x"}, "通識": {"大通識課"}, "9z9": {"9z9"}, "r&d x": {"-r&d xs"}}
    other = ["chair", "aisle", "9ai", "ai9", "xc++", "9z9s", "r&d xy", "通 識"]
    held = [(t, v) for t in texts for v in sorted(set().union(*texts.values())) + other]
    rows = spark.createDataFrame(held, "term string, t string").join(terms, "term").filter(F.rlike("t", F.col("pattern"))).collect()
    got = {}
    for r in rows:
        got.setdefault(r.term, set()).add(r.t)
    assert got == texts
