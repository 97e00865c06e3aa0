"""Saved-search filtering: query syntax, date windows and many searches over many records."""
from __future__ import annotations

import datetime as dt
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.dates import utc_to_local_date
from ..functions.rules import without_boilerplate
from ..functions.text import let, normalize_text
from ..session import work_path

@dataclass(frozen=True)
class SavedSearch:
    """Criteria of one saved search, a row of the table of searches."""
    name: str
    institutions: tuple[str, ...] | None = None     # empty selects nothing, None everything
    status: str = "all"
    date_basis: str = "effective"
    recent_days: str = "7"
    date_from: str = ""
    date_to: str = ""
    mode: str = "AND"
    query: str = ""
    exclude: str = ""
    preset_enabled: bool = False
    subject_keywords: str = ""
    role_keywords: str = ""
    preset_exclude: str = ""
    part_time_only: bool = False


def parse_query(c: Column) -> Column:
    """Struct (positive, negative, unclosed_quote) of a query text column.  The text and its terms are computed once: as a
    plain struct the optimiser would put them into every field that is read."""
    def parsed(q):
        tokens = F.regexp_extract_all(q, F.lit(r'(-?"[^"]+"|[^\s,，"]+)'), F.lit(1))
        terms = F.filter(F.transform(tokens, lambda t: F.struct(
            t.startswith("-").alias("minus"),
            F.trim(F.replace(F.when(t.startswith("-"), F.substr(t, F.lit(2))).otherwise(t), F.lit('"'), F.lit(""))).alias("term"))),
            lambda t: t["term"] != "")
        return let(terms, lambda ts: F.struct(
            F.transform(F.filter(ts, lambda t: ~t["minus"]), lambda t: t["term"]).alias("positive"),
            F.transform(F.filter(ts, lambda t: t["minus"]), lambda t: t["term"]).alias("negative"),
            (F.regexp_count(q, F.lit('"')) % 2 == 1).alias("unclosed_quote")))

    return let(c, parsed)


def keyword_terms(c: Column) -> Column:
    """Preset list: commas and line breaks separate, blanks inside a term stay."""
    return F.filter(F.transform(F.split(c, "[,，\n]"), lambda t: F.trim(t)), lambda t: t != "")


def effective_date() -> Column:
    """Advertised date, else the local date of the first sighting."""
    return F.coalesce(F.col("posted_date"), utc_to_local_date(F.col("first_seen")))


def recent_cutoff(today: Column, days: int) -> Column:
    return F.date_sub(today, days - 1)


def in_recent_window(day: Column, today: Column, days: int | None) -> Column:
    """Last ``days`` days with today included; future dates only pass "all" (None)."""
    if days is None:
        return F.lit(True)
    return F.coalesce(day.between(recent_cutoff(today, days), today), F.lit(False))


def date_basis(basis: str) -> Column:
    """Date that a from/to range tests; only a real closing date is a deadline."""
    if basis == "deadline":
        return F.when(F.col("deadline_type") == "closing", F.col("deadline"))
    return utc_to_local_date(F.col("first_seen")) if basis == "first_seen" else effective_date()


def in_range(day: Column, date_from: str = "", date_to: str = "") -> Column:
    """Inclusive range; an unknown date cannot pass a stated bound."""
    ok = F.lit(True)
    if date_from:
        ok = ok & F.coalesce(day >= F.lit(dt.date.fromisoformat(date_from)), F.lit(False))
    if date_to:
        ok = ok & F.coalesce(day <= F.lit(dt.date.fromisoformat(date_to)), F.lit(False))
    return ok


def status_filter(status: str) -> Column:
    return F.lit(True) if status == "all" else F.col("status") == status


def institution_filter(chosen: tuple[str, ...] | None) -> Column:
    """In a search an empty choice selects nothing; None means no choice was made."""
    if chosen is None:
        return F.lit(True)
    return F.col("source_id").isin(*chosen) if chosen else F.lit(False)


def part_time_filter() -> Column:
    return F.col("employment_type").isin(*V.PART_TIME_KINDS)


def with_search_text(ads: DataFrame, unicode_forms: bool = True, only=None) -> DataFrame:
    """Normalise each searched text once per record, whatever the number of searches.

    ``only`` tells per text whether a record needs it; others get an empty one.  Every step
    is a projection of its own, or the optimiser would repeat it in the next one.
    """
    optional = [c for c in ("subjects", "employment_type") if c in ads.columns]
    texts = {"_all": F.concat_ws("\n", "title", "department", *optional, "description"),
             "_subject": F.concat_ws("\n", "title", "department", without_boilerplate(F.col("description"))),
             "_title": F.col("title")}
    if only is not None:
        texts = {t: F.when(only(t), c) for t, c in texts.items()}
    joined = ads.withColumns(texts)
    return joined.withColumns({t: normalize_text(F.col(t), unicode_forms) for t in texts})


SEARCH_SCHEMA = ("name string, institutions array<string>, status string, date_basis string, recent_days string, "
                 "date_from string, date_to string, mode string, query string, exclude string, preset_enabled boolean, "
                 "subject_keywords string, role_keywords string, preset_exclude string, part_time_only boolean")
#: Runs of token characters, and every other character that is no blank, of normalised text.
_PIECES = "[a-z0-9]+|[^a-z0-9 ]"
TEXTS = ("_all", "_subject", "_title")
#: So many terms are looked for inside the row; they travel with every task.
FEW_TERMS = 200


def searches_table(spark: SparkSession, searches: list[SavedSearch]) -> DataFrame:
    """Configured searches as the table that ``match_saved_searches`` takes."""
    rows = [tuple(list(v) if isinstance(v, tuple) else v for v in astuple(s)) for s in searches]
    return spark.createDataFrame(rows, SEARCH_SCHEMA)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))


def search_terms(searches: DataFrame) -> DataFrame:
    """One row per search and term: name, kind (want, ban, subject, role), the text it is looked
    for in, the term as it stands in normalised text, its pattern and the pieces of which a text
    that holds it has one (its longest, also with a plural s where that is the last)."""
    def of(kind, text, terms, wanted=None):
        rows = F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"), t.alias("raw")))
        return rows if wanted is None else F.when(wanted, rows).otherwise(F.slice(rows, 1, 0))

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    asked, boxed, preset = parse_query(text("query")), parse_query(text("exclude")), F.coalesce("preset_enabled", F.lit(False))
    terms = F.concat(
        of("want", "_all", asked["positive"]), of("ban", "_all", asked["negative"]),
        # "-word" in the query and every term of the exclusion box stay mandatory under OR.
        of("ban", "_all", boxed["positive"]), of("ban", "_all", boxed["negative"]),
        of("subject", "_subject", keyword_terms(text("subject_keywords")), preset),
        of("role", "_title", keyword_terms(text("role_keywords")), preset),
        of("ban", "_all", keyword_terms(text("preset_exclude")), preset))
    rows = searches.select("name", F.inline(terms)).withColumn("term", normalize_text(F.col("raw"))).filter("term <> ''")
    starts, ends = F.col("term").rlike(r"\A[a-z0-9]"), F.col("term").rlike(r"[a-z0-9]\z")
    plural = F.col("term").rlike(r"[a-z]\z")
    quoted = F.concat(F.lit(r"\Q"), "term", F.lit(r"\E"))  # in lower case, so it cannot hold the mark that ends a quotation
    pattern = F.concat(  # the term first: Java looks for plain characters in leaps, and tests there what comes before
        quoted, F.when(starts, F.concat(F.lit("(?<![a-z0-9]"), quoted, F.lit(")"))).otherwise(""),
        F.when(plural, "s?").otherwise(""), F.when(ends, "(?![a-z0-9])").otherwise(""))
    pieces = _pieces(F.col("term"))
    longest = F.array_max(F.transform(pieces, lambda piece, i: F.struct(
        F.length(piece).alias("n"), (-i).alias("at"), piece.alias("piece"))))
    plural_piece = F.when(plural & (-longest["at"] == F.size(pieces) - 1), F.concat(longest["piece"], F.lit("s")))
    return rows.select("name", "kind", "text", "term", pattern.alias("pattern"), (longest["piece"] == F.col("term")).alias("single"),
                       F.array_compact(F.array(longest["piece"], plural_piece)).alias("pieces")).distinct()


def _joined_hits(prepared: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, hits) for any number of terms: texts meet terms by an equi-join on pieces, and the texts of records that may
    hold a term of several pieces come back once to prove it."""
    distinct = terms.select("text", "term", "pattern", "single", F.explode("pieces").alias("piece")).distinct()
    marked = lambda t: lambda piece: F.struct(F.lit(t).alias("text"), piece.alias("piece"))
    held = F.concat(*[F.transform(F.array_distinct(_pieces(F.col(t))), marked(t)) for t in TEXTS])
    # The outer form, because a derived "not empty" filter would be pushed below the normalising projection.
    met = (prepared.select(key, F.explode_outer(held).alias("h")).select(key, "h.*").join(distinct, ["text", "piece"])
           .groupBy(key).agg(F.collect_set(F.struct("text", "term", "pattern", "single")).alias("met")))
    return prepared.join(met, key).select(key, _proved(F.col("met")).alias("hits"))


def _proved(candidates: Column, surely: bool = True) -> Column:
    """The candidates that a record's texts hold.  Plain substring tests spare most of them the pattern; a term that is
    one piece and met as such (``surely``) needs no proof."""
    text = lambda t: F.when(t["text"] == "_title", F.col("_title")).when(t["text"] == "_subject", F.col("_subject")).otherwise(F.col("_all"))
    held = lambda t: F.contains(text(t), t["term"]) & F.rlike(text(t), t["pattern"])
    return F.transform(F.filter(candidates, lambda t: (t["single"] | held(t)) if surely else held(t)),
                       lambda t: F.struct(t["text"].alias("text"), t["term"].alias("term")))


def compiled(searches: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per search: the struct ``s`` of its typed bounds and the number of its terms."""
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    totals = terms.groupBy("name").agg(F.struct(*map(count, ("want", "subject", "role"))).alias("n"),
                                       F.collect_set(F.when(F.col("kind") == "ban", F.col("pattern"))).alias("ban"))
    total = lambda kind: F.coalesce("n." + kind, F.lit(0)).alias(kind)
    date = lambda c: F.when(F.col(c) != "", F.col(c).cast("date")).alias(c)
    return searches.join(totals, "name", "left").select("name", F.struct(
        "name", "institutions", F.coalesce("status", F.lit("all")).alias("status"), "date_basis",
        F.when(F.col("recent_days") != "all", F.col("recent_days").cast("int")).alias("recent_days"),
        date("date_from"), date("date_to"), F.coalesce(F.col("mode") == "OR", F.lit(False)).alias("any"),
        total("want"), total("subject"), total("role"), F.coalesce("ban", F.array().cast("array<string>")).alias("ban"),
        (F.coalesce("preset_enabled", F.lit(False)) & F.coalesce("part_time_only", F.lit(False))).alias("part_time")).alias("s"))


def within_bounds(s: Column, today: Column) -> Column:
    """Whether a record meets institutions, status, dates and employment of the search ``s``."""
    effective = effective_date()
    day = (F.when(s["date_basis"] == "deadline", date_basis("deadline"))
           .when(s["date_basis"] == "first_seen", date_basis("first_seen")).otherwise(effective))
    ok = ((s["institutions"].isNull() | F.array_contains(s["institutions"], F.col("source_id").cast("string")))
          & ((s["status"] == "all") | (F.col("status") == s["status"]))
          & (s["date_from"].isNull() | (day >= s["date_from"])) & (s["date_to"].isNull() | (day <= s["date_to"]))
          & (s["recent_days"].isNull() | effective.between(F.date_sub(today, s["recent_days"] - 1), today))
          & (~s["part_time"] | part_time_filter()))
    return F.coalesce(ok, F.lit(False))


def match_saved_searches(ads: DataFrame, searches: DataFrame, today: Column, key: str = "id",
                         unicode_forms: bool = True) -> DataFrame:
    """(search, record) pairs that match; the plan does not grow with the number of searches.

    The texts are normalised once; what they hold is written as narrow rows (the terms found, the open searches met), and the
    searches are counted out on those.  Up to ``FEW_TERMS`` terms are looked for inside the row; more of them meet
    the texts by a join on pieces.  Searches that need no term (institution, date or status only) travel as one array, a configured
    handful, and are tested inside the record.  ``name`` identifies a search and ``key`` a record; the texts are the matched
    record's own.
    """
    terms = search_terms(searches)
    named = compiled(searches, terms)
    needs = F.col("s.want") + F.col("s.subject") + F.col("s.role") > 0
    free = named.filter(~needs).agg(F.collect_list("s").alias("open")).scalar()
    passes = lambda s: within_bounds(s, today) & ~F.exists(s["ban"], lambda pattern: F.rlike(F.col("_all"), pattern))
    opened = F.transform(F.filter("_open", passes), lambda s: s["name"]).alias("open")
    prepared = with_search_text(ads, unicode_forms)
    wanted = terms.select("text", "term", "pattern").distinct()
    if wanted.count() <= FEW_TERMS:
        # substring tests of a few terms are cheaper than cutting every text into pieces; no text leaves its row
        known = wanted.agg(F.collect_list(F.struct("text", "term", "pattern"))).scalar()
        rows = prepared.withColumns({"_open": free, "_terms": known})
        narrow = _written(rows.select(key, _proved(F.col("_terms"), surely=False).alias("hits"), opened))
    else:
        prepared = _written(prepared)
        narrow = _written(prepared.withColumn("_open", free).select(key, opened).join(_joined_hits(prepared, terms, key), key, "left"))
    hits = narrow.select(key, F.explode("hits").alias("h")).select(key, "h.*").join(terms.select("name", "kind", "text", "term"), ["text", "term"])
    count = lambda kind: F.count_if(F.col("kind") == kind).alias("has_" + kind)
    pairs = hits.groupBy(key, "name").agg(*map(count, ("want", "ban", "subject", "role")))
    enough = (F.when(F.col("s.any"), F.col("has_want") >= F.least(F.col("s.want"), F.lit(1))).otherwise(F.col("has_want") == F.col("s.want"))
              & ((F.col("s.subject") == 0) | (F.col("has_subject") > 0)) & ((F.col("s.role") == 0) | (F.col("has_role") > 0)))
    chosen = pairs.filter("has_ban = 0").join(named.filter(needs), "name").filter(enough).select(key, "s")
    by_term = ads.join(chosen, key).filter(within_bounds(F.col("s"), today)).select(*ads.columns, F.col("s.name").alias("search"))
    by_rest = ads.join(narrow.select(key, F.explode("open").alias("search")), key).select(*ads.columns, "search")
    return by_term.unionByName(by_rest)


def _written(rows: DataFrame) -> DataFrame:
    path = work_path(rows.sparkSession, "search")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
