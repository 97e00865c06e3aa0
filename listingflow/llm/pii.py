"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The base patterns find email, ip, card and phone spans; failing matches are dropped.  The
field cuts the surroundings of digits and at signs into pieces (runs of letters or digits,
single signs) and scores whole segments of at most ``LONGEST`` pieces: shape, digit count
and groups, check sum, byte ranges, first signs, neighbours.  Dynamic programming over
segments chooses boundaries and types together.  Spans that no base span touches are added
if their posterior probability is at least ``CERTAIN``.

What it learns from: the windows around every mark of every document, grouped by their form
(letters and digits masked), so a frequent form is one row.  Each base span is also shown in
other ways of writing (``rewritten``) under its own kind: a telephone number without plus or with other
separators, a card in dotted groups, an address with spaced or bracketed signs; broken check
sums, broken byte ranges, cut numbers and everyday numbers are shown as no data.  Forms are fitted in shards of about ``SHARD``
forms and averaged.  Features are hashed into ``BUCKETS`` numbers, which bounds the model.
A window teaches nothing if its base spans do not begin and end with pieces, or if a base
pattern ran over several numbers there and failed for having too many digits.

Every whole text is searched.  Offsets are code points, ends exclusive.  Defined results:
null and empty texts have no spans; equal texts have equal spans; rows, repeated ones too, are kept one to
one; an empty table gives an empty one and a field that adds nothing; of equal segmentations the first found
counts; only doc_id and text are read, so further columns of any name do not matter.
"""
from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: The kinds in their order and the patterns of the base spans.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(]\x20?[Aa][Tt]\x20?[\])]")
#: Numbers of everyday texts that are no personal data.
CLEAN = ["2024-01-15", "15.01.2024", "01/15/2024", "12:30:45", "1,234,567.89", "3.11.2", "1990-2000", "pp. 112-118", "(3)", "10 000 000",
         "2024-01-15 12:30", "12 345 678", "123456789", "No. 4512-7", "5 x 10", "3.14159265358979"]

SHARD, BUCKETS, LONGEST, CERTAIN = 400, 1 << 18, 14, 0.9
_PIECE = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_AROUND = 24  # characters of context on both sides of a trigger


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")  # may be very long, so it is measured before it is read
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """All matches of EMAIL, found from their at signs: a search from every letter is slow."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    if not TRIGGER.search(text):
        return []
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(_is_byte(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# --- the field ------------------------------------------------------------------------

def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Piece spans of each stretch around digits and at signs; whole pieces only."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        if m.start() > end:
            if end >= 0:
                yield _pieces(text, start, end)
            start = max(0, m.start() - _AROUND)
            while start and text[start].isalnum() and text[start - 1].isalnum():
                start -= 1
        if m.end() + _AROUND > end:
            end = min(len(text), m.end() + _AROUND)
            while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                end += 1
    if end >= 0:
        yield _pieces(text, start, end)


def _pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _PIECE.finditer(text, start, end)]


_TO_SHAPE = {**{ord(c): "9" for c in "0123456789"}, **{c: "a" for c in [*range(65, 91), *range(97, 123)]}}
_RUNS = re.compile(r"(.)\1+")


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def span_features(text: str, start: int, end: int) -> list[int]:
    """Hashed features of a whole candidate segment."""
    piece = text[start:end]
    masked = piece.translate(_TO_SHAPE)
    shape = _RUNS.sub(r"\1", masked)
    groups = re.findall("[0-9]+", piece)
    count = sum(map(len, groups))
    letters = "a" in shape
    signs = "".join(sorted(set(shape) - set("9a")))[:8]
    lead = "00" if piece.startswith("00") else piece[0] if piece[0] in "+(0" else masked[0]
    out = [f"shape={shape[:24]}", f"digits={min(count, 21)}", f"groups={letters}{'-'.join(str(min(len(g), 20)) for g in groups[:6])}",
           f"at={piece.count('@')}{bool(_AT.search(piece))}{'.' in piece}", f"signs={letters}{signs}",
           f"lead={lead}{len(groups)}{letters}", f"band={letters}{(count > 8) + (count > 12) + (count > 15) + (count > 19)}{lead}"]
    if letters:  # names and hosts of any parts look alike
        out.append("parts=" + _DOTTED.sub("x", re.sub("[9a]+", "x", shape))[:24])
    if 13 <= count <= 19 and not letters:
        out.append(f"luhn={luhn(''.join(groups))}")
    if len(groups) == 4 and not letters:
        out.append(f"bytes={all(len(g) < 4 and int(g) < 256 for g in groups)}{signs}")
    before, after = text[start - 1:start], text[end:end + 1]
    out.append(f"before={before.translate(_TO_SHAPE) if not before.isspace() else ' '}")
    out.append(f"after={after.translate(_TO_SHAPE) if not after.isspace() else ' '}")
    return [_number(f) for f in out]


_DOTTED = re.compile(r"x(?:[._%+-]x)+")
_AT = re.compile(r"[\[(]\x20?[Aa][Tt]\x20?[\])]")


def _marked(text: str, start: int, end: int) -> bool:
    """A piece with a digit, an at sign, or the word at in brackets."""
    if text[start:end] in ("at", "At", "AT"):
        return bool(_AT.search(text, max(0, start - 2), end + 2))
    return bool(_DIGIT.search(text, start, end))


_DIGIT = re.compile("[0-9@]")
_ANY = _number("any")


def segments(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(first piece, end piece, features) of all candidates: they hold a mark and end in a letter or digit."""
    found = []
    marked = [_marked(text, s, e) for s, e in pieces]
    for i, (start, _) in enumerate(pieces):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        any_mark = False
        for j in range(i, min(i + LONGEST, len(pieces))):
            if j > i and pieces[j][0] - pieces[j - 1][1] > 1:
                break  # more than one space inside
            any_mark = any_mark or marked[j]
            if any_mark and text[pieces[j][1] - 1].isalnum():
                found.append((i, j + 1, span_features(text, start, pieces[j][1])))
    return found


def _outside(text: str, span: tuple[int, int]) -> int:
    c = text[span[0]]
    return _number("out=" + ("digit" if _DIGIT.search(text, *span) else "word" if c.isalnum() else c))


def _candidates(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, tuple, list[int]]]:
    """(first piece, end piece, kinds it may have, features); None is the kind of a single piece outside."""
    return ([(k, k + 1, (None,), [_outside(text, span)]) for k, span in enumerate(pieces)]
            + [(i, j, tuple(KINDS), features + [_ANY]) for i, j, features in segments(text, pieces)])


def _scored(size: int, candidates, weights):
    """Edges by end piece: (first piece, kind or None, score, features)."""
    edges = [[] for _ in range(size + 1)]
    get = weights.get
    for i, j, kinds, features in candidates:
        for kind in kinds:
            edges[j].append((i, kind, sum([get((kind, f), 0.0) for f in features]), features))
    return edges


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _forward_backward(edges):
    n = len(edges) - 1
    ahead = [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_sum([ahead[i] + s for i, _, s, _ in edges[j]])
    back = [[] for _ in range(n + 1)]
    behind = [0.0] * (n + 1)
    for j in range(n, 0, -1):
        behind[j] = _log_sum(back[j]) if j < n else 0.0
        for i, _, s, _ in edges[j]:
            back[i].append(s + behind[j])
    return ahead, behind


# --- what the field learns from -------------------------------------------------------

def _by_kind(spans) -> dict[str, list[tuple[int, int]]]:
    found: dict = {}
    for kind, start, end in spans:
        found.setdefault(kind, []).append((start, end))
    return {kind: sorted(places) for kind, places in found.items()}


def _touching(by_kind: dict, start: int, end: int) -> list[tuple[int, int, str]]:
    """Spans that share a character with start..end; spans of one kind do not overlap."""
    found = []
    for kind, places in by_kind.items():
        k = max(0, bisect.bisect_left(places, (start,)) - 1)
        while k < len(places) and places[k][0] < end:
            if places[k][1] > start:
                found.append((*places[k], kind))
            k += 1
    return sorted(found)


def _run_together(window: str) -> bool:
    """Whether a base pattern took too many digits at once, so that its failing says nothing."""
    digits = lambda m: sum(c.isdigit() for c in m[0])
    return any(digits(m) > 15 for m in PHONE.finditer(window)) or any(digits(m) > 19 for m in CARD.finditer(window))


def windows(text: str, longest: int = 40, beside: int = 2) -> Iterator[tuple[str, str, list[tuple[str, int, int]]]]:
    """(form, window, its base spans) around all marks; a stretch of marks is cut after ``longest`` pieces, never inside a base span."""
    if not TRIGGER.search(text):
        return
    base = _by_kind(base_spans(text))
    for pieces in regions(text):
        marks = [k for k, (s, e) in enumerate(pieces) if _marked(text, s, e)]
        stretches = []
        for m in marks:
            if stretches and m - stretches[-1][1] <= 2 * beside:
                first, last = stretches[-1]
                ends, starts = pieces[last][1], pieces[m][0]
                if m - first <= longest or any(s < ends and starts < e for s, e, _ in _touching(base, ends - 1, starts + 1)):
                    stretches[-1] = (first, m)
                    continue
            stretches.append((m, m))
        for first, last in stretches:
            start, end = pieces[first][0], pieces[last][1]
            for s, e, _ in _touching(base, start, end):
                start, end = min(start, s), max(end, e)
            low = max(0, bisect.bisect_left(pieces, (start,)) - beside)
            high = min(len(pieces), bisect.bisect_left(pieces, (end,)) + beside)
            left, right = max(0, min(start, pieces[low][0]) - 1), max(end, pieces[high - 1][1]) + 1
            spans = [(kind, s - left, e - left) for s, e, kind in _touching(base, left, right) if left <= s and e <= right]
            window = text[left:right]
            if _run_together(window):
                continue
            form = re.sub(r"\s", " ", re.sub("[0-9]", "9", re.sub(r"[^\W\d_]+", "a", window)))
            yield f"{','.join(k for k, _, _ in spans)}|{form}", window, spans


def rewritten(kind: str, surface: str) -> list[tuple[bool, str]]:
    """(still personal data, other way of writing it) of a base span."""
    groups = re.findall("[0-9]+", surface)
    digits = "".join(groups)
    if kind == "phone":
        here = groups[1:] if len(groups) > 2 and len(groups[0]) < 4 else []
        good = ["00" + " ".join(groups), "00" + "-".join(groups)] if len(groups) > 1 else []
        if sum(map(len, here)) >= 9:
            good += [sign.join(here) for sign in " -."] + [f"({here[0]}) {sign.join(here[1:])}" for sign in " -"]
            good += ["0" + sign.join(here) for sign in " -"]
        bad = [digits, "-".join(groups[-2:]), " ".join(groups[-2:]), groups[-1]]
    elif kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        fours = lambda d: [d[k:k + 4] for k in range(0, len(d), 4)]
        signs = [".", "/", "_", " - ", " / "]
        good = [sign.join(fours(digits)) for sign in signs]
        bad = [sign.join(fours(wrong)) for sign in [*signs, "", " ", "-"]]
    elif kind == "ip":
        signs = ["[.]", "(.)", " . ", " [.] "]
        good = [sign.join(groups) for sign in signs]
        bad = [sign.join([*groups[:3], str(int(groups[3][-3:]) + 256)]) for sign in [*signs, "."]] + [".".join(groups[:3])]
    else:
        name, _, host = surface.partition("@")
        plain = re.sub("[._%+-]*[0-9]+", "", name) or "me", re.sub("-?[0-9]+", "", host)
        good = [f"{n}{sign}{h}" for n, h in {(name, host), plain} for sign in [" @ ", "[at]", " [at] ", "(at)", " (at) "]]
        bad = [f"{name} @ {host.split('.')[0]}", f"@{name}", host, f"{plain[0]} (at) {plain[1].split('.')[0]}"]
    return [(True, g) for g in good if not base_spans(g)] + [(False, b) for b in bad if b and not base_spans(b)]


def examples(window: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """The window, and each of its base spans rewritten among its neighbours."""
    yield window, spans
    ordered = sorted(spans, key=lambda s: s[1])
    for k, (kind, start, end) in enumerate(ordered):
        left = window[max([e for _, _, e in ordered[:k] if e <= start], default=0):start]
        right = window[end:min([s for _, s, _ in ordered[k + 1:] if s >= end], default=len(window))]
        place = lambda text: (left + text + right, [(kind, len(left), len(left) + len(text))])
        for good, text in rewritten(kind, window[start:end]):
            yield place(text)[0], place(text)[1] if good else []
        first = zlib.crc32(window.encode())
        for text in [CLEAN[(first + step) % len(CLEAN)] for step in (0, 5, 10)]:
            yield place(text)[0], []


def _prepared(text: str, truth: list[tuple[str, int, int]]):
    """(pieces, candidates, features of the true segmentation), None if a true span does not fit the pieces."""
    pieces = _pieces(text, 0, len(text))
    candidates = _candidates(text, pieces)
    wanted, covered, gold = {(s, e): kind for kind, s, e in truth}, set(), []
    for i, j, kinds, features in candidates:
        kind = wanted.get((pieces[i][0], pieces[j - 1][1])) if kinds[0] else None
        if kind and not covered & set(range(i, j)):
            gold.append((kind, features))
            covered |= set(range(i, j))
    if len(gold) < len(wanted):
        return None
    gold += [(None, features) for i, _, kinds, features in candidates if kinds[0] is None and i not in covered]
    return len(pieces), candidates, gold


def fit(learned: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 8, rate: float = 0.3) -> dict:
    """Weights (kind, feature) by stochastic gradient on the likelihood of the true segmentations of windows."""
    weights: dict = {}
    cases = sorted({(zlib.crc32(t.encode()), t, tuple(truth)) for window in learned for t, truth in examples(*window)})
    cases = [c for c in (_prepared(t, list(truth)) for _, t, truth in cases) if c and c[0]]
    for epoch in range(epochs):
        step = rate / (1 + epoch / 2)
        for size, candidates, gold in cases:
            edges = _scored(size, candidates, weights)
            ahead, behind = _forward_backward(edges)
            total, change = ahead[-1], {}
            for j, into in enumerate(edges):
                for i, kind, s, features in into:
                    chance = math.exp(min(0.0, ahead[i] + s + behind[j] - total))
                    if chance > 1e-4:
                        for f in features:
                            change[kind, f] = change.get((kind, f), 0.0) - chance
            for kind, features in gold:
                for f in features:
                    change[kind, f] = change.get((kind, f), 0.0) + 1.0
            for key, c in change.items():
                weights[key] = weights.get(key, 0.0) * (1 - 1e-3 * step) + step * c
    return weights


def train(texts: list[str]) -> dict:
    """The field of a few texts, without Spark; ``learn`` does the same for a table."""
    forms: dict = {}
    for text in texts:
        for form, window, spans in windows(text):
            forms[form] = min(forms.get(form, (window, spans)), (window, spans))
    return fit(list(forms.values()))


# --- search ---------------------------------------------------------------------------

def best_segments(text: str, pieces: list[tuple[int, int]], weights: dict) -> list[tuple[str, int, int, float]]:
    """The best segmentation: (kind, start, end, posterior) of its entities."""
    edges = _scored(len(pieces), _candidates(text, pieces), weights)
    best = [(0.0, None)] + [(-math.inf, None)] * len(pieces)
    for j in range(1, len(edges)):
        best[j] = max(((best[i][0] + s, (i, kind, s)) for i, kind, s, _ in edges[j]), key=lambda x: x[0])
    path, j = [], len(pieces)
    while j:
        i, kind, s = best[j][1]
        if kind:
            path.append((i, j, kind, s))
        j = i
    if not path:
        return []
    ahead, behind = _forward_backward(edges)
    return [(kind, pieces[i][0], pieces[j - 1][1], math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[-1])))
            for i, j, kind, s in reversed(path)]


def all_spans(text: str, weights: dict) -> list[tuple[str, int, int, bool]]:
    """Base spans and those the field adds: (kind, start, end, is base), by kind and start."""
    base = base_spans(text)
    spans = [(*b, True) for b in base]
    if weights and TRIGGER.search(text):
        taken = _by_kind(base)
        for pieces in regions(text):
            if not pieces:
                continue
            for kind, start, end, chance in best_segments(text, pieces, weights):
                if chance >= CERTAIN and not _touching(taken, start, end):
                    spans.append((kind, start, end, False))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


WINDOW = "window: string, spans: array<struct<kind: string, start: int, end: int>>"


def learn(docs: DataFrame, shard: int = SHARD) -> dict:
    """Fit on the forms around all marks of all documents, in shards; at most ``BUCKETS`` weights a kind come to the driver."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for batch in batches:
            forms: dict = {}  # the first reduction, before the shuffle
            for text in batch.column(0):
                for form, window, spans in windows(text.as_py() or ""):
                    forms[form] = min(forms.get(form, (window, spans)), (window, spans))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(forms), pa.string()), pa.array([w for w, _ in forms.values()], pa.string()),
                 pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for _, spans in forms.values()], kind)],
                ["form", "window", "spans"])

    def fit_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("form")
        found = fit([(w, [(s["kind"], s["start"], s["end"]) for s in spans]) for w, spans in zip(rows.window, rows.spans)])
        return pd.DataFrame([(k or "", f, w) for (k, f), w in found.items()], columns=["kind", "feature", "weight"])

    forms = stored(docs.select("text").mapInArrow(cut, f"form string, {WINDOW}").groupBy("form")
                   .agg(F.min(F.struct("window", "spans")).alias("least")).select("form", "least.*"), "pii-forms")
    shards = max(1, math.ceil(forms.count() / shard))
    fitted = (forms.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards))).groupBy("shard")
              .applyInPandas(fit_shard, "kind string, feature int, weight double"))
    rows = stored(fitted, "pii-weights").groupBy("kind", "feature").agg(F.avg("weight").alias("weight")).toPandas()
    return {(k or None, f): w for k, f, w in rows.itertuples(index=False)}


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def find_spans(docs: DataFrame, weights: dict) -> DataFrame:
    """doc_id and all spans of each whole text, by kind and start."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def search(batches):
        w = shared.value
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "base"), s)) for s in all_spans(t.as_py() or "", w)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {id_type}, spans {SPANS}")
