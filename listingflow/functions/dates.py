"""Date columns: only dates that a page states explicitly."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import clean_text, let, rx, text_lines


_MONTHS = "," + ",".join(V.MONTH_NAMES)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def _named_day(year: Column, label: Column, day: Column) -> Column:
    """Date with a month given by the start of its English name; null for other words."""
    short = F.initcap(F.substring(label, 1, 3))
    known = F.lit(_MONTHS).contains(F.concat(F.lit(","), F.lower(label)))
    return F.when(known, F.try_to_date(F.concat_ws(" ", day, short, year), "d MMM y"))


def _first_match(c: Column, pattern: str, build) -> Column:
    """``build`` applied to the three groups of the first match, null without a match."""
    pattern = rx(pattern, False)
    return let(F.regexp_extract(c, pattern, 0), lambda m: F.when(m != "", build(
        *[F.regexp_extract(m, pattern, i) for i in (1, 2, 3)])))


def parse_date(c: Column) -> Column:
    """First stated date: Y-M-D, then D Month Y, then Month D, Y; an impossible date
    in one form falls through to the next."""
    def forms(v):
        return F.when(v.contains("20"), F.coalesce(
            _first_match(v, V.YMD_DATE, lambda y, m, d: _day(y, m, d)),
            _first_match(v, V.DMY_DATE, lambda d, m, y: _named_day(y, m, d)),
            _first_match(v, V.MDY_DATE, lambda m, d, y: _named_day(y, m, d))))

    return let(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), V.HYPHEN_DATE, "$1 $2 $3"), forms)


def strip_format_chars(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{Cf}", "")


def parse_date_locale(c: Column, date_order: Column) -> Column:
    """Stated date, else numeric D/M/Y for sources whose locale was verified as DMY."""
    whole = r"(?U)\A\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](20\d{2})\s*\z"

    def forms(v):
        d, m, y = (F.regexp_extract(v, whole, i) for i in (1, 2, 3))
        return F.coalesce(parse_date(v), F.when((date_order == "DMY") & v.rlike(whole), _day(y, m, d)))

    return let(strip_format_chars(c), forms)


def feed_date_mdy(c: Column) -> Column:
    """M/D/YYYY of a feed with a declared en-US locale; "-" and blank mean no date."""
    return F.when(c.rlike(r"\A\d{1,2}/\d{1,2}/\d{4}\z"), F.try_to_date(c, "M/d/y"))


def feed_stamp_utc(c: Column) -> Column:
    """"Fri Sep 04 23:00:00 UTC 2026" -> local calendar date."""
    shape = r"\A\w{3} (\w{3}) (\d{1,2} \d{2}:\d{2}:\d{2}) UTC (\d{4})\z"
    parts = F.concat_ws(" ", *[F.regexp_extract(c, shape, i) for i in (3, 1, 2)])
    return F.when(c.rlike(shape), utc_to_local_date(F.try_to_timestamp(parts, F.lit("y MMM d HH:mm:ss"))))


def utc_to_local_date(ts: Column, zone: str = V.TIME_ZONE) -> Column:
    """Calendar date of a UTC wall clock in the monitor's zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_date(c: Column) -> Column:
    """Offset timestamps convert to the local zone first; anything else parses plainly."""
    stamped = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})\z"
    stamp = F.when(c.rlike(stamped), F.try_to_timestamp(c))
    return F.coalesce(F.when(stamp.isNotNull(), utc_to_local_date(stamp)), parse_date(c))


def _fragment(lines: Column, i: Column, n: int) -> Column:
    joined = F.array_join(F.slice(lines, i + 1, F.lit(n)), " ")
    return F.substring(joined, 1, V.FRAGMENT_LIMIT)


def _result(day: Column, kind: str, raw: Column) -> Column:
    return F.struct(day.cast("date").alias("deadline"), F.lit(kind).alias("deadline_type"),
                    raw.alias("deadline_raw"))


def _first(found: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda r: r.isNotNull()), F.lit(1))


def deadline_from(text: Column) -> Column:
    """Struct (deadline, deadline_type, deadline_raw) by label priority.

    Closing label (with the two lines after it) > review line > until-filled line.
    Each rule looks at lines only in texts that hold its label at all.
    """
    no_day = F.lit(None).cast("date")

    def closing(fragment, day):
        dated = _result(day, "closing", fragment)
        return (F.when(fragment.rlike(rx(V.EARLIER_WORDS)) & day.isNotNull(), dated)
                .when(fragment.rlike(rx(V.ONGOING_NEAR_LABEL)), _result(no_day, "until-filled", fragment))
                .when(day.isNotNull(), dated))

    def by_label(lines):
        return _first(F.transform(lines, lambda line, i: F.when(
            line.rlike(rx(V.CLOSING_LABEL)),
            let(_fragment(lines, i, 3), lambda f: let(parse_date(f), lambda d: closing(f, d))))))

    def by_line(lines, pattern, kind, day_of):
        line = F.try_element_at(F.filter(lines, lambda x: x.rlike(rx(pattern))), F.lit(1))
        return let(line, lambda x: F.when(x.isNotNull(), _result(day_of(x), kind, F.substring(x, 1, V.FRAGMENT_LIMIT))))

    def rules(body):
        lines = text_lines(body)
        return F.coalesce(
            F.when(body.rlike(rx(V.CLOSING_LABEL)), let(lines, by_label)),
            F.when(body.rlike(rx(V.REVIEW_LABEL)), by_line(lines, V.REVIEW_LABEL, "review", parse_date)),
            F.when(body.rlike(rx(V.ONGOING_LINE)), by_line(lines, V.ONGOING_LINE, "until-filled", lambda _: no_day)),
            _result(no_day, "unknown", F.lit("")))

    return let(clean_text(text), rules)


def posted_from(text: Column) -> Column:
    """Date on a line labelled as the posting date, or on the line after it."""
    def labelled(lines):
        return _first(F.transform(lines, lambda line, i: F.when(
            line.rlike(rx(V.POSTED_LABEL)), parse_date(F.array_join(F.slice(lines, i + 1, F.lit(2)), " ")))))

    return let(clean_text(text), lambda body: F.when(
        body.rlike(rx(V.POSTED_LABEL)), let(text_lines(body), labelled)))


def explicit_apply_by(text: Column) -> Column:
    """A fixed apply-by date; it outranks a standard until-filled footer."""
    by = F.regexp_extract(text, rx(V.APPLY_BY), 1)
    on = F.regexp_replace(F.regexp_extract(text, rx(V.APPLY_ON_OR_BEFORE), 1),
                          r"\b(20\d)\s+(\d)\b", "$1$2")
    return F.coalesce(parse_date(by), parse_date(on))


def deadline_with_apply_by(text: Column) -> Column:
    """Deadline of a detail page: a fixed apply-by date first, then the labelled lines."""
    def choose(day):
        raw = F.concat(F.lit("Application deadline: "), F.date_format(day, "d MMMM y"))
        return F.when(day.isNotNull(), _result(day, "closing", raw)).otherwise(deadline_from(text))

    return let(explicit_apply_by(text), choose)
