"""Rule columns: role, employment kind and the text used for subject matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from .text import (fold_text, holds, let, line_holds_any, matched_terms, nfkc, normalize_term, normalize_text, rx,
                   shared_pieces, text_lines)


def role_of(title: Column, unicode_forms: bool = True) -> Column:
    def role(value):
        out = F.when(value.rlike(rx(V.ADJUNCT_FACULTY, False)), F.lit("lecturer"))
        for name, pattern in V.ROLE_PATTERNS:
            out = out.when(value.rlike(rx(pattern, False)), F.lit(name))
        return out.otherwise("other")

    return let(normalize_text(title, unicode_forms), role)


def title_employment(title: Column, explicit: Column | None = None, unicode_forms: bool = True) -> Column:
    """Kind stated by the title (cut before "for"/"to teach") or the list, else null."""
    def kind(primary):
        part, full = primary.rlike(V.PART_WORDS), primary.rlike(V.FULL_WORDS)
        return (F.when(part & full, "mixed").when(part, "part-time")
                .when(primary.rlike(V.HOURLY_TITLE), "hourly").when(full, "full-time"))

    head = F.regexp_extract(title, rx(rf"(?s)\A(.*?)(?:{V.TITLE_CUT}|\z)"), 1)
    primary = F.concat_ws(" ", head, explicit if explicit is not None else F.lit(""))
    return let(F.regexp_replace(normalize_text(primary, unicode_forms), V.FULLTIME_STUDY, ""), kind)


def body_employment(normalized: Column) -> Column:
    """Kind from direct employment statements of a normalised body, else unknown."""
    return (F.when(normalized.contains("parttime") & normalized.rlike(V.PART_BODY), "part-time")
            .when(normalized.contains("hourly rate") & normalized.rlike(V.HOURLY_BODY), "hourly")
            .otherwise("unknown"))


def with_employment(df: DataFrame, title: Column, explicit: Column | None = None,
                    body: Column | None = None, unicode_forms: bool = True) -> DataFrame:
    """Add ``employment_type``.  Bodies are normalised once, and only where the title says
    nothing; each step is a projection of its own so that no text is folded twice."""
    out = df.withColumn("_stated", title_employment(title, explicit, unicode_forms))
    if body is None:
        return out.withColumn("employment_type", F.coalesce("_stated", F.lit("unknown"))).drop("_stated")
    text = F.when(F.col("_stated").isNull(), F.coalesce(body, F.lit("")))
    out = out.withColumn("_formed", nfkc(text) if unicode_forms else text).withColumn(
        "_folded", fold_text(F.col("_formed")))
    return out.withColumn("employment_type", F.coalesce("_stated", body_employment(F.col("_folded")))).drop(
        "_stated", "_formed", "_folded")


def _clean_line(line: Column) -> Column:
    """A line as it counts for subjects; null for a footer line."""
    def rules(low):
        plain = F.regexp_replace(line, rx(V.DEGREE_PHRASE), "")
        generic = holds(low, V.SKILL_WORDS) & line.rlike(rx(V.APPLICANT_LINE)) & ~line.rlike(rx(V.TEACHING_LINE))
        return (F.when(holds(low, V.FOOTER_WORDS), F.lit(None).cast("string"))
                .when(generic, F.regexp_replace(plain, rx(V.SKILL_PHRASE), ""))
                .when(holds(low, V.DEGREE_WORDS), plain).otherwise(line))

    return let(F.lower(line), rules)


def without_boilerplate(text: Column) -> Column:
    """Drop employer footers, degree names and generic applicant skills, line by line.

    Most texts and lines hold none of the phrases: plain substring tests, far cheaper
    than the patterns, let them through untouched.
    """
    phrases = V.FOOTER_WORDS + V.DEGREE_WORDS + V.SKILL_WORDS
    cleaned = F.array_join(F.array_compact(F.transform(text_lines(text), _clean_line)), "\n")
    return F.when(let(F.lower(text), lambda low: holds(low, phrases)), cleaned).otherwise(text)


def subject_text(title: Column, department: Column, match_text: Column, description: Column) -> Column:
    body = F.coalesce(F.nullif(match_text, F.lit("")), description, F.lit(""))
    return F.concat(title, F.lit("\n"), F.coalesce(department, F.lit("")), F.lit("\n"),
                    without_boilerplate(body))


def _snippet(terms: list[str], fallback: Column) -> Column:
    """First raw line whose folded form holds a term; a term that only appears across a
    line break has no such line, then the term itself is the evidence."""
    first = F.try_element_at(F.filter("_lines", lambda p: line_holds_any(p["low"], terms)), F.lit(1))
    return F.substring(F.coalesce(F.trim(first["raw"]), fallback), 1, V.SNIPPET_LIMIT)


def with_subject_hits(df: DataFrame, text: Column, unicode_forms: bool = True) -> DataFrame:
    """Add ``hits``: an array of (subject, label, weight, terms, snippet).

    The dictionary is configuration, so its terms are literals of the plan: no join and
    no shuffle.  A text is normalised once (a projection of its own, or the optimiser
    would repeat it per term); pieces that several terms share are looked for once, a term
    only where its piece is, and only texts that hold it pay for the bounded pattern; lines
    are folded only where a term may be.
    """
    out = df.withColumn("_raw", text)
    out = out.withColumn("_formed", nfkc(F.col("_raw")) if unicode_forms else F.col("_raw"))
    out = out.withColumn("_folded", fold_text(F.col("_formed")))
    pieces = shared_pieces(normalize_term(t) for *_, terms in V.SUBJECTS for t in terms)
    held = {piece: f"_held_{i}" for i, piece in enumerate(dict.fromkeys(pieces.values()))}
    out = out.withColumns({name: F.col("_folded").contains(piece) for piece, name in held.items()})
    found = {sid: f"_terms_{i}" for i, (sid, *_) in enumerate(V.SUBJECTS)}
    may_hold = lambda t: F.col(held[pieces[normalize_term(t)]]) if normalize_term(t) else F.lit(False)
    out = out.withColumns({found[sid]: matched_terms(F.col("_folded"), terms, may_hold) for sid, _, _, terms in V.SUBJECTS})
    any_hit = F.lit(False)
    for name in found.values():
        any_hit = any_hit | (F.size(name) > 0)
    lines = F.arrays_zip(text_lines(F.col("_raw")).alias("raw"),
                         text_lines(F.lower("_formed")).alias("low"))
    out = out.withColumn("_lines", F.when(any_hit, lines))
    hits = [F.when(F.size(found[sid]) > 0, F.struct(
        F.lit(sid).alias("subject"), F.lit(label).alias("label"), F.lit(weight).alias("weight"),
        F.col(found[sid]).alias("terms"), _snippet(terms, F.col(found[sid])[0]).alias("snippet")))
        for sid, label, weight, terms in V.SUBJECTS]
    return out.withColumn("hits", F.array_compact(F.array(*hits))).drop(
        "_raw", "_formed", "_folded", "_lines", *held.values(), *found.values())


def score_of(hits: Column, role: Column, employment: Column) -> Column:
    top = F.coalesce(F.array_max(F.transform(hits, lambda h: h["weight"])), F.lit(0))
    bonus = (F.size(hits) > 0) & employment.isin(*V.PART_TIME_KINDS) & role.isin(*V.NOTIFY_ROLES)
    return F.when(bonus, F.least(F.lit(V.SCORE_CAP), top + V.ROLE_BONUS)).otherwise(
        F.least(top, F.lit(V.NO_BONUS_CAP)))


def is_match(hits: Column, score: Column, role: Column, employment: Column, source_id: Column,
             searchable: Column, exclude: list[str] = (), institutions: list[str] = (),
             require_part_time: bool = True) -> Column:
    """Notification decision; an empty institution list means every institution."""
    ok = (F.size(hits) > 0) & (score >= V.MIN_SCORE) & role.isin(*V.NOTIFY_ROLES)
    if require_part_time:
        ok = ok & employment.isin(*V.PART_TIME_KINDS)
    if exclude:
        lowered = F.lower(nfkc(F.coalesce(searchable, F.lit(""))))
        ok = ok & ~let(lowered, lambda low: line_holds_any(low, list(exclude)))
    if institutions:
        ok = ok & source_id.isin(*institutions)
    return ok


def published_match(matches: Column, detail_complete: Column, description: Column) -> Column:
    """Decision that is published: an incomplete record without any body never matches."""
    return matches & (detail_complete | (F.coalesce(description, F.lit("")) != ""))
