"""Text columns: cleaning, normalising and bounded term tests (Column -> Column)."""
from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import Column, functions as F

from .. import fixed_values as V

# Unicode white space plus the separators that also end a line.
_WS = r"[\s\x1c-\x1f]"
_BREAK = "[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
# The same characters one by one, behind a plain range that turns letters and Han away at once.
_BLANK = ("[\\x00-\\x20\\x80-\\u3000&&[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]]")
# A run of them that is not already one blank.
_BLANK_RUN = f"{_BLANK}(?:(?<! )|(?={_BLANK})){_BLANK}*"


def rx(pattern: str, ignore_case: bool = True) -> str:
    """Java flags under which a pattern treats case, words and dots as Unicode text."""
    return ("(?iuUd)" if ignore_case else "(?Ud)") + pattern


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A column used several times in one expression is otherwise repeated in the plan,
    and a long chain of them outgrows a generated method.
    """
    return F.transform(F.array(value), body)[0]


def clean_text(c: Column) -> Column:
    """Collapse blanks inside lines, trim lines, drop blank lines, keep line breaks."""
    blanks = F.regexp_replace(F.coalesce(c, F.lit("")), "[\\t \\u00a0]+", " ")
    lines = F.regexp_replace(blanks, f"(?U){_WS}*{_BREAK}{_WS}*", "\n")
    return F.regexp_replace(lines, f"(?U)\\A{_WS}+|{_WS}+\\z", "")


def nfkc(c: Column) -> Column:
    """Compatibility normalisation inside the JVM, by the ICU library Spark ships; plain ASCII
    is not handed over, and the library passes normal text through faster than a pattern tests it.

    Spark counts a reflective call as non-deterministic, so use the result in a
    projection.  That also keeps the optimiser from repeating what is built on it.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(~ascii_only(c), composed).otherwise(c)


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


#: The commonest characters of running text first; others are rarer.
_COMMON_FIRST = " etaoinshrdlcumwfgypbvkjxqz"


def shared_pieces(terms) -> dict[str, str]:
    """For every term a piece of it, chosen (at plan time) so that few pieces serve all terms: a text
    without the piece cannot hold the term.  Pieces under five bytes would spare few texts; of equal
    ones the best is that whose first character is rare, as the search stops at each of those."""
    def pieces(term):
        return {term[i:j] for i in range(len(term)) for j in range(i + 1, len(term) + 1)
                if len(term[i:j].encode()) >= 5} or {term}

    left, chosen = {t: pieces(t) for t in terms if t}, {}
    while left:
        held = Counter(p for ps in left.values() for p in ps)
        best = max(held, key=lambda p: (held[p], _COMMON_FIRST.find(p[0]) % 99, len(p), p))
        chosen |= {t: best for t in left if best in left[t]}
        left = {t: ps for t, ps in left.items() if best not in ps}
    return chosen


def _any_of(c: Column, pieces) -> Column:
    hit = F.lit(False)
    for piece in pieces:
        hit = hit | c.contains(piece)
    return hit


def holds(c: Column, pieces) -> Column:
    """Whether the text holds one of the pieces; what they share is looked for first."""
    pieces = list(pieces)
    shared = sorted(set(shared_pieces(pieces).values()))
    exact = _any_of(c, pieces)
    return _any_of(c, shared) & exact if "" not in pieces and len(shared) < len(pieces) else exact


def _one_word(c: Column) -> Column:
    # the patterns begin with plain characters, which Java looks for in leaps
    for word in ("part", "full"):
        c = let(c, lambda v: F.when(v.contains(word), F.regexp_replace(
            v, rx(rf"{word}(?<=\b{word})[\s-]*time\b", False), word + "time")).otherwise(v))
    return c


def fold_text(c: Column) -> Column:
    """The part of normalisation after NFKC: case, dashes, part/full time, blanks.

    Substring tests decide whether a rewrite can change a text before it runs over it.
    """
    return fold_lowered(F.lower(c))


def fold_lowered(c: Column) -> Column:
    """``fold_text`` of a text that is in lower case already."""
    c = let(c, lambda v: F.when(
        ~ascii_only(v) & holds(v, V.DASHES), F.translate(v, V.DASHES, "-" * len(V.DASHES))).otherwise(v))
    c = let(c, lambda v: F.when(v.contains("time"), _one_word(v)).otherwise(v))
    return F.trim(F.regexp_replace(c, _BLANK_RUN, " "))


def normalize_text(c: Column, unicode_forms: bool = True) -> Column:
    """Normalised text; ``unicode_forms=False`` skips the composition step for text that is
    known to be in compatibility form already."""
    c = F.coalesce(c, F.lit(""))
    return fold_text(nfkc(c) if unicode_forms else c)


_PLAIN_DASH = str.maketrans(dict.fromkeys(V.DASHES, "-"))
_SPLIT_WORDS = re.compile(r"\b(?P<share>part|full)[\s-]*time\b")
_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def normalize_term(term: str) -> str:
    """The form a configured term takes in normalised text (plan-time constant)."""
    folded = unicodedata.normalize("NFKC", term or "").lower().translate(_PLAIN_DASH)
    return " ".join(_SPLIT_WORDS.sub(r"\g<share>time", folded).split())


def term_regex(term: str, plural: bool = False) -> str | None:
    """Pattern that finds a term in normalised text; None for a blank term.

    Token characters are a-z and 0-9.  A term that begins (ends) with one must not have
    another right before (after) it, so "ai" is not found in "chair"; scripts without
    token characters match anywhere.  A plural also matches with an s after a letter.
    The term stands first in the pattern, so Java looks for it in leaps; what comes before is
    tested where it was found.
    """
    value = normalize_term(term)
    if not value:
        return None
    term = re.escape(value)
    before = f"(?<![a-z0-9]{term})" if value[0] in _TOKEN else ""
    after = "(?![a-z0-9])" if value[-1] in _TOKEN else ""
    optional = "s?" if plural and value[-1] in _TOKEN and not value[-1].isdigit() else ""
    return term + before + optional + after


def contains_term(normalized: Column, term: str, plural: bool = False) -> Column:
    """Bounded containment; the plain substring test spares most texts the pattern."""
    pattern = term_regex(term, plural)
    if pattern is None:
        return F.lit(False)
    hit = normalized.contains(normalize_term(term)) & normalized.rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def anchor(term: str) -> str:
    """A piece every text that holds the term must hold before blanks and dashes are folded."""
    words = [w for w in re.split(r"[\s-]+", normalize_term(term)) if "parttime" not in w and "fulltime" not in w]
    return max(words, key=len, default="")


def line_holds_any(lowered: Column, terms: list[str]) -> Column:
    """Whether a lower-case line holds one of the terms; only candidate lines are folded."""
    pieces = sorted({anchor(t) for t in terms if normalize_term(t)})
    return holds(lowered, pieces) & let(fold_lowered(lowered), lambda f: contains_any(f, terms))


def contains_any(normalized: Column, terms: list[str], plural: bool = False) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | contains_term(normalized, t, plural)
    return hit


def matched_terms(normalized: Column, terms: list[str], may_hold=lambda term: F.lit(True)) -> Column:
    """The terms that occur, in dictionary order; ``may_hold`` is a cheaper test that they pass."""
    hits = [F.when(may_hold(t) & contains_term(normalized, t), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*hits))


def text_lines(c: Column) -> Column:
    return F.split(c, "\n")


def escape_markdown(c: Column, limit: int = 240) -> Column:
    return F.substring(F.regexp_replace(c, r"([\\*_`~>|\[\]])", r"\\$1"), 1, limit)


def safe_link(url: Column) -> Column:
    """Usable https link with brackets and blanks encoded, else an empty string."""
    link = F.replace(F.replace(F.replace(url, F.lit(")"), F.lit("%29")), F.lit("("), F.lit("%28")),
                     F.lit(" "), F.lit("%20"))
    return F.when(url.rlike(r"^(?i:https)://([^/?#@]*@)?[^/?#@:]+"), link).otherwise(F.lit(""))


def safe_cell(c: Column) -> Column:
    """CSV cell that a spreadsheet cannot read as a formula."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike("(?U)" + V.FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def csv_cell(c: Column) -> Column:
    """A quoted cell as the search page downloads it."""
    return F.concat(F.lit('"'), F.replace(safe_cell(c), F.lit('"'), F.lit('""')), F.lit('"'))
