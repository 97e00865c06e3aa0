"""Small cases of the training-data operators: brute force, edge rows, repeated rows, empty tables."""
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from listingflow.llm import (decontaminate, licenses, lm_scoring, mixing, neighbours, pii, quality, queries, sharding,
                             simhash, suffix_dedup)
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, part_no string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def passage(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n).tolist())


LONG = passage(1, 400)
ROWS = [(1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (None, "no id " + passage(2, 30)), (5, passage(3, 20000)),
        (6, "x " + LONG[200:900] + " y"), (7, "aaaa" * 200), (8, "mail a.b@c-d.org or +1 (555) 123-4567, 4111 1111 1111 1111, 10.0.0.255"),
        (8, "other text of the same id"), (9, "   \n\t "), (10, "Ünï " * 60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 3}", 0, "clash", "clash", "clash") for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_license_scan", "op3_suffix_array_dedup"])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])[0] == []


def test_mix_takes_whole_documents_near_the_target(docs, empty):
    plan = mixing.plan_mix(docs).toPandas()
    assert len(plan) == len(ROWS) and (plan.taken <= 3 * plan["size"]).all()
    total = plan["size"].sum()
    assert abs(plan.drop_duplicates("source_size").target.sum() - total) < 1e-6 * total
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan.copies.sum()
    assert mixing.plan_mix(empty).count() == 0


def test_positions_invert_the_schedule(spark):
    knots = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.5, 3.0), ("a", 1.0, 0.0)], "source string, t double, weight double")
    row = mixing.integrated(knots).first()
    assert row.weight == pytest.approx(1.75)
    from pyspark.sql import functions as F
    at = mixing.integrated(knots).select(mixing.position(F.lit(1.0), F.col("pieces")).alias("a"), mixing.position(F.lit(0.4375), F.col("pieces")).alias("b")).first()
    assert at.a == pytest.approx(0.5) and 0.25 < at.b < 0.35


def test_shards_differ_by_one_row_and_slots_are_gapless(docs, empty):
    rows = sharding.assign(docs, 4).toPandas()
    counts = rows.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert len(rows) == len(ROWS) and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    assert sorted(rows.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t in ROWS)
    again = sharding.assign(docs.repartition(3), 4).toPandas()
    key = ["doc_id", "text_crc32", "shard", "slot"]
    assert sorted(map(str, rows[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert sharding.assign(empty).count() == 0


def brute_repeats(rows):
    """Covered bytes by the rule, straight from all strings of 100 bytes."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows}, key=lambda r: r[:2])
    seen, out = set(), {}
    for none, i, t in order:
        raw, gone, new = t.encode(), np.zeros(len(t.encode()), bool), set()
        for p in range(len(raw) - 99):
            s = raw[p:p + 100]
            if s in seen or s in new:
                gone[p:p + 100] = True
            new.add(s)
        seen |= new
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone]) if raw else b""
        out[(None if none else i), t] = (len(raw), int(gone.sum()), int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_brute_force(docs, empty):
    want = brute_repeats(ROWS)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(i, *want[i, t or ""]) for i, t in ROWS], key=str)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order_is_the_sorted_order(seed):
    text = np.random.default_rng(seed).integers(1, 4, 500).astype(np.uint8)
    order = suffix_dedup.suffix_order(text, 500)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(500), key=lambda i: raw[i:])


def test_fingerprints_and_components_equal_brute_force(docs, empty):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    prints = [fp(t) for _, t in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    group[i] = min(group[i], group[j])
    first = {g: min((ROWS[k][0] for k in range(len(ROWS)) if group[k] == g and ROWS[k][0] is not None), default=None) for g in group}
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(i, format(p, "016x"), first[g]) for (i, _), p, g in zip(ROWS, prints, group)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_tree_finds_all_pairs():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([points, points ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), points[:50] ^ np.uint64(0b11011)]))
    found = {(min(i, j), max(i, j)) for a, b in simhash.vantage_pairs(points) for i, j in zip(a.tolist(), b.tolist())}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    assert found == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


def test_large_shards_lose_no_pair(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 60).tolist()
    fps = sorted({b ^ (1 << int(k)) for b in base for k in rng.integers(0, 62, 4)} | set(base))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    rows = simhash.shards(df, large=1).toPandas()
    together = set()
    for _, g in rows.groupby(["shard", "bits", "ring"]).fp:
        v = sorted(set(g))
        together |= {(a, b) for k, a in enumerate(v) for b in v[k + 1:]}
    assert all((a, b) in together for k, a in enumerate(fps) for b in fps[k + 1:] if (a ^ b).bit_count() <= 4)


def test_quality_learns_and_scores_all_rows(spark, docs, empty):
    whole = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    scored = quality.score_documents(whole, quality.train(whole, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() >= 0.9
    blank = quality.train(docs, labels.where("false"))
    got = quality.score_documents(docs, blank).toPandas()
    assert len(got) == len(ROWS) and (got.score == 0.5).all()
    assert quality.keep_good(docs, blank).columns == docs.columns and quality.keep_good(empty, blank).count() == 0


def test_base_spans_follow_the_patterns():
    text = ROWS[9][1]
    assert [text[s:e] for _, s, e in pii.base_spans(text)] == ["a.b@c-d.org", "10.0.0.255", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    assert pii.base_spans("1.2.3.256, 4111111111111112, +12345 a@b") == []
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    for t in ["a@b.c@d.e", "x@@y.z", "%@a.b.c-", "a@b.c.", "é@b.c q@r.s"]:
        assert [(s, e) for k, s, e in pii.base_spans(t) if k == "email"] == [m.span() for m in pii.EMAIL.finditer(t)]


def test_field_learns_the_base_spans(docs, empty):
    texts = [f"call +1 ({a}) 555-{b} or mail n{a}@h{b}.org from 10.{a % 250}.3.4 now {b}" for a, b in zip(range(200, 400), range(1000, 1200))]
    weights = pii.train(texts)
    hit = [s for t in texts[:20] for p in pii.regions(t) for s in pii.best_segments(t, p, weights)]
    assert len(hit) >= 50
    got = pii.find_spans(docs, weights).collect()
    assert len(got) == len(ROWS) and pii.find_spans(empty, weights).count() == 0


def _calls(n):
    rng = np.random.default_rng(4)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    for k in range(n):
        card = digits(15)
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        ip = ".".join(str(x) for x in rng.integers(1, 256, 4))
        yield (f"call +1 ({rng.integers(200, 999)}) 555-{digits(4)} or +{rng.integers(31, 50)} {rng.integers(10, 99)} {digits(4)} {digits(4)} "
               f"today, room {k}. mail ann{k}@host{k % 9}.example.org from {ip} or eve.lee@mail.example.com{",.; "[k % 4]} pay {"with: (on"[k % 3 * 3:k % 3 * 3 + 4]} {card}{" ,.;)"[k % 5]} until 3.{k % 12 + 1}.2024")


def test_field_adds_other_ways_of_writing_and_leaves_clean_numbers(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*_calls(150), None, ""])], "doc_id long, text string, spans string")
    weights = pii.learn(docs)
    found = lambda text: [(k, text[s:e]) for k, s, e, _ in pii.all_spans(text, weights)]
    for kind, surface in [("phone", "555-123-4567"), ("phone", "(212) 555 0100"), ("phone", "0044 20 7946 0958"), ("card", "4111.1111.1111.1111"),
                          ("ip", "24[.]88[.]50[.]48"), ("email", "joe.doe [at] mail.example.org"), ("email", "kim77(at)host4.example.org")]:
        assert found(f"please use {surface} for it") == [(kind, surface)], surface
    for clean in ["4111.1111.1111.1112", "at 12:30 on 2024-01-15", "1,234,567 of 10 000 000", "pages 112-118 of version 3.11.2", "order 12345678",
                  "1999 2000 2001 2002 2003", "3.141592653589793", "24[.]88[.]50[.]300", "meet me [at] home"]:
        assert found(f"we saw {clean} there") == [], clean
    joined = "ring +1 (269) 555-3296 452413227 now"  # the pattern runs on and fails
    assert pii.base_spans(joined) == [] and found(joined)[:1] == [("phone", "+1 (269) 555-3296")]
    assert {(r.doc_id, len(r.spans)) for r in pii.find_spans(docs, weights).where("doc_id >= 150").collect()} == {(150, 0), (151, 0)}
    assert pii.learn(docs.where("false")) == {}


def test_segments_are_the_best_of_all_segmentations():
    weights = pii.train(list(_calls(30)))
    for text in ["at +1 (212) 555-0100 x", "a@b.org 7", "10[.]2[.]3[.]4", "5 555-123-4567"]:
        pieces = pii._pieces(text, 0, len(text))
        edges = pii._scored(len(pieces), pii._candidates(text, pieces), weights)

        def paths(j):
            return [((), 0.0)] if j == 0 else [((*p, (i, j, kind)), total + s) for i, kind, s, _ in edges[j] for p, total in paths(i)]
        every = paths(len(pieces))
        best = max(every, key=lambda p: p[1])
        assert [(k, s, e) for k, s, e, _ in pii.best_segments(text, pieces, weights)] == [
            (kind, pieces[i][0], pieces[j - 1][1]) for i, j, kind in best[0] if kind]
        top = max(s for _, s in every)
        whole = top + np.log(sum(np.exp(s - top) for _, s in every))
        assert pii._forward_backward(edges)[0][-1] == pytest.approx(whole)


def test_base_spans_equal_a_plain_search():
    rng = np.random.default_rng(8)
    alphabet = list("0123456789" * 3 + ".-+() @ab%\u00e9\n")
    for _ in range(400):
        text = "".join(rng.choice(alphabet, 60)) + rng.choice(["4111 1111-11111111", "+1 (212) 555-0100", "1.22.3.255", "a@b.co"])
        digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
        check = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and check(digits(m))]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(text) == want, text


def test_decontamination_finds_edited_copies(spark, docs, empty):
    rng = np.random.default_rng(9)
    names = [f"w{k}" for k in range(3000)]
    items = [rng.choice(names, 40).tolist() for _ in range(3)]
    edited = [w if k % 8 else "other" for k, w in enumerate(items[0])]
    noise = rng.choice(names, 300).tolist()
    rows = [(1, " ".join(noise + items[1] + noise)), (2, " ".join(noise + edited)), (3, " ".join(noise)), (4, " ".join(items[2][:20])), (5, None)]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(7, None), (8, ""), (9, "two words")], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(table, bench).collect()) == [(1, 1), (2, 0)]
    assert sorted(r.doc_id for r in decontaminate.without_leaks(table, bench).collect()) == [3, 4, 5]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_gradients_are_those_of_the_loss():
    net = {k: v.astype(np.float64) for k, v in lm_scoring.initial().items()}
    rng = np.random.default_rng(1)
    net = {k: v + rng.normal(0, 0.1, v.shape) for k, v in net.items()}
    targets = rng.integers(0, lm_scoring.SYMBOLS, (3, 5))
    inputs = rng.integers(0, lm_scoring.SYMBOLS, (3, 5))
    h = np.zeros((3, lm_scoring.HIDDEN))
    _, grad, _ = lm_scoring.gradients(net, inputs, targets, h)
    for name, at in (("u", (2, 5)), ("u", (3, 40)), ("x", (inputs[0, 1], 7)), ("c", (4, 3)), ("w", (targets[0, 0] // lm_scoring.PER_CLASS, 2, 1))):
        change = {k: v.copy() for k, v in net.items()}
        change[name][at] += 1e-4
        up = lm_scoring.gradients(change, inputs, targets, h)[0]
        change[name][at] -= 2e-4
        down = lm_scoring.gradients(change, inputs, targets, h)[0]
        assert grad[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5)


def test_language_model_scores(spark, docs, empty):
    got = lm_scoring.score_documents(docs).toPandas()
    assert len(got) == len(ROWS) and np.isfinite(got.score).all() and (got.n_tokens >= 1).all()
    probabilities = lm_scoring.log_probabilities(lm_scoring.initial(), np.zeros((lm_scoring.SYMBOLS, lm_scoring.HIDDEN), np.float32), np.arange(lm_scoring.SYMBOLS))
    assert np.exp(probabilities).sum() == pytest.approx(1, abs=1e-3)
    assert lm_scoring.score_documents(empty).count() == 0


def test_neighbours_reach_the_brute_force_recall(spark):
    x = np.random.default_rng(3).normal(size=(600, 16)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 10).toPandas()
    assert set(got.query_id) == set(range(0, 600, 20)) and (got.groupby("query_id").size() == 10).all()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10]) & set(g.vec_id))
        assert np.allclose(s[g.sort_values("rank").vec_id], g.sort_values("rank").score)
    assert hit / (10 * 30) >= 0.9
    few = neighbours.nearest(df.where("vec_id < 4"), F.col("vec_id") == 0, 10).toPandas()
    assert len(few) == 3 and neighbours.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_neighbours_of_repeated_vectors_and_beside_a_long_one(spark):
    rng = np.random.default_rng(41)
    points = rng.normal(size=(3000, 16))
    points[::3] = points[0]  # a third of the rows are equal
    points[1] *= 1000
    ids = rng.permutation(3000)
    rows = [(int(i), p.tolist(), 1) for i, p in zip(ids, points)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int").withColumn("row", F.lit(0))
    found = neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    place, hits = {int(i): k for k, i in enumerate(ids)}, 0
    assert sorted(by_query) == list(range(0, 3000, 20))
    # equal vectors have equal products in every order of summation that both sides use
    products = points @ points.T
    products[:, ::3] = products[:, :1]
    for query, got in by_query.items():
        score = products[place[query]]
        best = sorted((i for i in map(int, ids) if i != query), key=lambda i: (-score[place[i]], i))[:20]
        assert len(got) == 20 and query not in got
        hits += len(set(got) & set(best))
    assert hits >= 0.98 * 20 * len(by_query)
    assert neighbours.nearest(table.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "code"), (3, "a/b/c/y.txt", "Licensed under CC BY-NC 4.0.\nmore"),
            (4, "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."), (5, "a/b/c/d/z.txt", None), (6, "q/z.txt", ""), (7, None, "license to nothing at all, says he")]
    got = {r.doc_id: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("MIT", "a"), 3: ("CC-BY-NC-4.0", None), 4: ("Apache-2.0", None), 5: ("Apache-2.0", "a/b/c"), 6: (None, None), 7: (None, None)}


def test_license_headers_wrapped_notices_and_files(spark):
    own = {"SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "// SPDX-License-Identifier: BSD-3-Clause\nint x;": "BSD-3-Clause",
           "You can redistribute it and/or modify it\nunder the terms of the GNU General Public License as\npublished by the Free Software Foundation, either version 3 of\nthe License, or later.": "GPL-3.0",
           "* Licensed under the Apache\n* License, Version 2.0.\n* more": "Apache-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0",
           "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:": "BSD-3-Clause",
           "we talk of a license to fish in the river": None, "SPDX-License-Identifier: ISC": None, "cc me on this": None,
           "\n".join(["plain words here"] * 50000 + ["Released under the", "MIT License."]): "MIT"}
    rows = [(k, f"p{k}/x.c", text, "row", 0) for k, text in enumerate(own)]
    files = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None)], "doc_id long, path string, text string, row_no string, score int")
    got = licenses.scan(files).collect()
    assert sorted((r.doc_id, r.own_license) for r in got if r.doc_id is not None) == sorted([*enumerate(own.values()), (0, "MIT")], key=lambda x: x[0])
    assert len(got) == len(rows) + 2 and licenses.scan(files.where("false")).count() == 0


def test_license_files_stand_above_leaf_folders_and_ties_are_settled(spark, docs):
    notice = {n: t for n, t in reversed(licenses.NOTICES)}
    rows = [(0, "code"), (3, notice["MIT"]), (49, "code"), (51, "code"), (1001, "code"), (2, notice["GPL-3.0"]), (6, notice["Apache-2.0"]), (50001, "code")]
    table = spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.path, r.license, r.inherited_from) for r in licenses.scan(licenses.document_files(table)).collect()}
    # id 3: three levels up; ids 2 and 6: two levels up, of equal score
    assert got[3][0] == "web/en/LICENSE-3" and got[2][0] == "web/en/0/LICENSE-2"
    assert got[0] == got[0][:1] + ("Apache-2.0", "web/en/0") and got[51][1:] == got[1001][1:] == ("Apache-2.0", "web/en/0")
    assert got[50001] == ("web/en/1/50/1000/50001.txt", "MIT", "web/en")
    assert licenses.scan(licenses.document_files(docs)).count() == len(ROWS)


def test_pipeline_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_near_copies_of_five_words_and_similarity_08_are_dropped(spark):
    rng = np.random.default_rng(17)
    names = [f"w{k}" for k in range(4000)]
    rows, expected = [], []
    for base in range(40):
        words = rng.choice(names, 150 + 20 * base).tolist()
        rows.append((10 * base, " ".join(words)))
        expected.append(10 * base)
        for copy, share in ((1, 0.01), (2, 0.018), (3, 0.08)):
            edited = [f"new{base}x{copy}x{k}" if e else w for k, (w, e) in enumerate(zip(words, rng.random(len(words)) < share))]
            rows.append((10 * base + copy, " ".join(edited)))
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    group = {i: i for i, _ in rows}
    for _ in range(4):
        for i in sets:
            for j in range(i // 10 * 10, i // 10 * 10 + 4):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    assert 50 < len(set(group.values())) < 110
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(table).collect()) == sorted(set(group.values()))
    assert simhash.keep_one(table.where("false")).count() == 0


def test_a_large_group_of_edited_copies_is_linked_as_by_brute_force_and_makes_few_pairs(spark):
    from listingflow.llm import near_copies
    rng = np.random.default_rng(29)
    base = rng.choice([f"w{k}" for k in range(5000)], 200).tolist()
    texts = []
    for copy in range(160):
        share = (0.0 if copy == 0 else rng.uniform(0.005, 0.06))
        texts.append(" ".join(f"e{copy}x{k}" if e else w for k, (w, e) in enumerate(zip(base, rng.random(200) < share))))
    sets = [near_copies.shingles(t.encode()) for t in texts]
    root = list(range(160))
    for i in range(160):
        for j in range(i):
            if root[i] != root[j] and near_copies.similar(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert len(set(root)) > 5
    nodes = spark.createDataFrame([(k, len(s), [1]) for k, s in enumerate(sets)], "key long, n long, buckets array<long>")
    table = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "key long, text binary")
    got = {r.u: r.v for r in near_copies.linked_sets(nodes, table).collect()}
    assert [got.get(k, k) for k in range(160)] == root
    alone = spark.createDataFrame([(k, len(s), k, [int(x) for x in s.view(np.int64)]) for k, s in enumerate(sets) if root.count(root[k]) == 1],
                                  "key long, n long, root long, shingles array<long>")
    assert near_copies.prefix_pairs(alone).count() <= alone.count()


def test_near_copies_handle_nulls_ties_repeats_and_clashing_names(spark):
    text = passage(31, 60)
    rows = [(None, text, 1), (4, text, 2), (4, text, 3), (2, text + " more", 4), (7, None, 5), (6, "", 6), (9, "one two", 7), (9, "One  two", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long").withColumnRenamed("key", "copy_no").withColumn("root", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 9]


def test_near_copies_do_not_depend_on_the_first_member_of_a_bucket(spark):
    from listingflow.llm import near_copies
    words = passage(23, 400).split()
    texts = [words[:380], words[:340], words[40:380], words[20:360], [f"n{k}" for k in range(300)]]
    keys = [5, 1, 3, 2, 4]  # every key shares a bucket; only some pairs are similar
    nodes = spark.createDataFrame([(k, len(near_copies.shingles(" ".join(t).encode())), [7]) for k, t in zip(keys, texts)], "key long, n long, buckets array<long>")
    table = spark.createDataFrame([(k, " ".join(t).encode()) for k, t in zip(keys, texts)], "key long, text binary")
    got = {r.u: r.v for r in near_copies.linked_sets(nodes, table).collect()}
    assert got == {2: 1, 3: 1, 5: 1}


def test_dense_shards_are_joined_without_holding_their_pairs():
    import tracemalloc
    rng = np.random.default_rng(8)
    points = np.zeros(6000, np.uint64)
    for _ in range(5):
        points ^= np.uint64(1) << rng.integers(0, 20, len(points), dtype=np.uint64)
    points = rng.permutation(np.unique(np.concatenate([points, rng.integers(0, 1 << 63, 300, dtype=np.uint64), points[:40] << np.uint64(30)])))
    tracemalloc.start()
    moved, low = simhash.spanning(points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    label = np.arange(len(points))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    for _ in range(60):
        label = np.array([label[n].min() for n in near])
    got = np.arange(len(points))
    got[moved] = low
    assert (got == label).all() and peak < 30e6


def test_decontamination_allows_for_inserted_words(spark):
    names = [f"w{k}" for k in range(3000)]
    item = np.random.default_rng(12).choice(names, 40, replace=False).tolist()
    doubled = lambda every: " ".join(f"new{k}a new{k}b" if k % every == 2 else w for k, w in enumerate(item))
    table = spark.createDataFrame([(1, doubled(5)), (2, doubled(4)), (3, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert sorted((r.doc_id, r.equal_words) for r in decontaminate.leaks(table, bench).collect()) == [(1, 32), (3, 40)]


def test_decontamination_equals_alignment_of_all_pairs(spark):
    rng = np.random.default_rng(31)
    names = [f"w{k}" for k in range(60)]  # few words: grams repeat and common ones are no seeds
    items = [(i, " ".join(rng.choice(names, int(n)))) for i, n in enumerate([3, 4, 7, 12, 20, 40, 40, 90])] + [(8, "one two"), (9, None), (10, "")]
    items += [items[5]]

    def edited(words, lost, added):
        out = list(words)
        for at in rng.permutation(len(out))[:lost]:
            out[at] = f"x{at}" if rng.random() < 0.5 else None
        out = [w for w in out if w]
        for at in sorted(rng.integers(1, len(out), added), reverse=True):
            out.insert(int(at), f"y{at}")
        return out
    docs = [(None, None), (1, ""), (1, "one two"), (2, passage(5, 20_000))]
    for i, text in items[:8]:
        words = text.split()
        for share in (0.0, 0.1, 0.2, 0.3):
            copy = edited(words, int(share * len(words)), int(share * len(words)))
            docs.append((len(docs), " ".join([*rng.choice(names, 30), *copy, *rng.choice(names, 30)])))
    docs += docs[5:8]
    assert decontaminate.surviving(40) == 15
    want = set()
    for k, (doc_id, text) in enumerate(docs):
        codes = decontaminate.word_codes((text or "").encode())
        for item_id, item in items:
            part = decontaminate.word_codes((item or "").encode())
            if len(part) >= 3 and len(codes):
                found = decontaminate.align(part, codes)
                if found and found[0] >= 0.8 * len(part):
                    want.add((doc_id, item_id, found[0]))
    table = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, item_id int, similarity string")
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    rows = decontaminate.leaks(table, bench).collect()
    assert {(r.doc_id, r.item_id, r.equal_words) for r in rows} == want and len(want) > 20
    assert sum(r.doc_id == docs[5][0] and r.item_id == 0 for r in rows) == 2  # repeated rows match each for itself
    kept = decontaminate.without_leaks(table, bench)
    hit = {d for d, *_ in want}
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.where("doc_id > 2").collect()) == sorted(d for d, _ in docs if d and d > 2 and d not in hit)
