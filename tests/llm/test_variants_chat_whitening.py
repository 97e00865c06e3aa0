"""Spelling variants, chat formatting and whitening: brute force, round trips, edge rows."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest

from listingflow.llm import chat_format, queries, spelling, whitening
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_chat_format"])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])[0] == []


# spelling variants

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice(list("abÀÿé"), rng.integers(6, 9))) for _ in range(25)]
    words = []
    for s in stems:
        i = int(rng.integers(len(s)))
        for k, v in enumerate([s, s[:i] + "c" + s[i + 1:], s[:i] + s[i + 1:] + "d", s + "e", "f" + s, s[:i] + s[i:]]):
            words += [v.upper() if k == 1 else v] * int(rng.choice([3, 5, 6, 30, 160]))
    words += ["levels"] * 800 + ["levelx"] * 160 + ["levely"] * 150 + ["levelxy"] * 30 + ["levelxyz"] * 6 + ["tieone", "tietwo"] * 40 + ["tienne"] * 8
    words = [words[i] for i in rng.permutation(len(words))]
    rows = [(i // 9 if i % 7 else None, " ".join(words[i:i + 40]) + (", 12×÷3 " if i % 80 else "")) for i in range(0, len(words), 40)]
    rows += rows[:2] + [(1, None), (2, ""), (3, "a " * 50_000 + "levels")]
    docs = spark.createDataFrame([(i, t, "x", "x", 1) for i, t in rows], "doc_id long, text string, word string, n string, root long")
    want = expected_variants(rows)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == want and any(v[1] != k and v[1] != v[0] for k, v in want.items())
    assert spelling.variants(docs.where("false")).count() == 0


def test_crowded_chunks_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    words = sorted({"common" + "".join(rng.choice(list("ab"), rng.integers(3, 8))) for _ in range(300)}
                   | {"".join(rng.choice(list("ab"), rng.integers(3, 8))) + "ending" for _ in range(300)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(a, b) for a in words for b in words if (len(a), a) < (len(b), b) and one_edit(a, b)}
    for crowd in (0, 8, 10 ** 6):
        pairs = [tuple(r) for r in spelling.near_pairs(frame, crowd).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


# chat formatting

TURNS = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "<s>[\\INST]\\"), (1, 3, "user", None),
         (1, 4, "assistant", "[/INST]</s><\\/s>[\\\\INST] ü😀\n"), (2, 0, "user", "alone"), (3, 0, "assistant", ""), (3, 1, "user", "end ["),
         (None, 0, "user", "q"), (None, 1, "assistant", "a"), (4, 0, None, "no role"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"),
         (4, None, "user[INST] ", "last"), (5, 0, "user", "x" * 100_000), (5, 1, "assistant", "y [INST] " * 20_000)]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, "c", "c", 1) for t in TURNS], "conv_id long, turn long, role string, text string, piece string, whole string, loss long")


def conversations():
    out = defaultdict(list)
    for c, t, r, x in TURNS:
        out[c].append((t is None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(rows)] for c, rows in out.items()}


def test_chat_digests_are_read_back(turns):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.examples(turns)).collect()}
    assert set(got) == set(conversations())
    for c, rows in conversations().items():
        loss = "".join(x for r, x in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), digest("".join(f"{r}\n{x}\n" for r, x in rows)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss))


def test_each_reply_is_an_example_after_all_turns_before(turns):
    made = defaultdict(list)
    for r in chat_format.examples(turns).collect():
        made[r.conv_id].append(r)
    undo = lambda s: re.sub(r"([\[<])\\(\\*)(/?INST\]|/?s>)", r"\1\2\3", s)
    for c, rows in conversations().items():
        got = sorted(made[c], key=lambda r: r.n_turns)
        ends = [k + 1 for k, (r, _) in enumerate(rows) if r == "assistant"]
        assert [r.n_turns for r in got] == ends + ([] if rows[-1][0] == "assistant" else [len(rows)])
        assert [r.whole for r in got] == [False] * (len(got) - 1) + [True]
        for r in got:
            parts = re.findall(r"(?s)<s>(.*?)\[INST\] (.*?) \[/INST\]</s>", r.text)
            assert [(undo(a), undo(b)) for a, b in parts] == rows[:r.n_turns]
            assert "".join(f"<s>{a}[INST] {b} [/INST]</s>" for a, b in parts) == r.text
            if r.loss_start is not None:
                assert undo(r.text[r.loss_start:r.loss_end]) == rows[r.n_turns - 1][1] and r.n_turns in ends
    assert chat_format.read_back(chat_format.examples(turns.where("false"))).count() == 0


# whitening

def test_polynomial_is_exact(spark):
    m = [[2, -1, 0], [-1, 2, -1], [0, -1, 2]]  # (x - 2)(x^2 - 4x + 2)
    assert whitening.characteristic_polynomial(spark, m) == [-4, 10, -6, 1]
    rng = np.random.default_rng(5)
    a = rng.integers(-10 ** 9, 10 ** 9, (7, 4)).astype(object)
    m = (a @ a.T).tolist()  # rank 4
    poly = whitening.characteristic_polynomial(spark, m)
    assert poly[:3] == [0, 0, 0] and poly[3] and poly[7] == 1 and poly[6] == -sum(m[i][i] for i in range(7))
    roots = whitening.largest_roots(poly, 8)
    assert len(roots) == 4
    assert np.allclose([float(r) for r in roots], np.linalg.eigvalsh(np.array(m, float))[::-1][:4], rtol=1e-9)
    for r in roots:  # a sign change within 50 digits
        low, high = r * (1 - Decimal(10) ** -20), r * (1 + Decimal(10) ** -20)
        assert whitening.roots_above(poly, int(low), 0) - whitening.roots_above(poly, int(high) + 1, 0) == 1


def test_repeated_roots_have_orthogonal_components(spark):
    q = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])  # orthogonal rows of norm 4
    m = (q.T @ np.diag([5, 5, 5, 2]) @ q).tolist()  # 20 three times, 8
    poly = whitening.characteristic_polynomial(spark, m)
    roots = whitening.largest_roots(poly, 8)
    assert [round(float(r), 12) for r in roots] == [20, 20, 20, 8]
    axes = whitening.eigenvectors(m, roots)
    assert np.allclose(axes @ axes.T, np.eye(4), atol=1e-14) and np.allclose(axes @ np.array(m) @ axes.T, np.diag([20, 20, 20, 8]), atol=1e-12)


VECTORS = "vec_id long, embedding array<float>, n long, component string, vector string"


def expected_whitening(vectors, d):
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] + [100000] * (d - len(v)) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, values[::-1], np.abs(centred @ axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-30)))


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    good = [rng.normal(0, [3, 2, 1, .5, .4, .3, .2, .1, .05, .02]).tolist() for _ in range(120)] + [[0.5] * 10] * 60 + [[1.0, -2.0], []]
    rows = [(i if i % 9 else None, v) for i, v in enumerate(good)]
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 10), (903, [float("-inf")] + [0.0] * 9)]
    frame = spark.createDataFrame([(i, v, 1, "c", "c") for i, v in rows + bad], VECTORS).repartition(5)
    out = whitening.whiten(frame).toPandas()
    n, deviation, values, whitened = expected_whitening(good, 10)
    assert len(out) == len(good) * 8 and set(out.n) == {n} and out.identity_error.max() < 1e-10
    for k in range(8):
        part = out[out.component == k + 1]
        assert np.allclose(part.explained, values[k] / values.sum(), rtol=1e-9)
        got = sorted((int(a), round(abs(b), 6)) for a, b in zip(part.deviation, part.whitened))
        want = sorted((a, round(b, 6)) for a, b in zip(deviation, whitened[:, k]))
        assert [a for a, _ in got] == [a for a, _ in want] and np.allclose([b for _, b in got], [b for _, b in want], atol=1e-5)


def test_whitening_of_few_equal_large_and_no_rows(spark):
    frame = lambda vs: spark.createDataFrame([(i, v, 1, "c", "c") for i, v in enumerate(vs)], VECTORS)
    assert whitening.whiten(frame([[1.0, 2.0]])).count() == 0
    assert whitening.whiten(frame([[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(frame([[], None])).count() == 0
    assert whitening.whiten(frame([None]).where("false")).count() == 0
    two = whitening.whiten(frame([[0.0, 1.0], [1.0, 1.0], [3.0, 1.0]])).toPandas()  # one dimension varies
    assert set(two.component) == {1} and (two.explained == 1).all() and sorted(map(int, two.deviation)) == sorted((3 * a - 4096) ** 2 for a in (0, 1024, 3072))
    large = whitening.whiten(frame([[3e38, 1.0], [-3e38, 2.0], [1e12, 0.0]])).toPandas()
    assert large.identity_error.max() < 1e-6 and set(large.component) == {1, 2}
