"""Training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import ann, bwt, chat, licenses, mixing, packing, pfor, quality, queries, simhash, suffixes, tokens, toxicity
from siltstone.llm.components import components
from siltstone.llm.common import Scratch
from siltstone.llm.pipeline_steps import readable

SF = "/root/testdata/sf0.001"
#: Nulls, empty and long texts, repeated rows and ids, and columns whose names the operators use themselves.
ODD = [(1, "a b c d e f g h i j", "x"), (2, None, None), (3, "", "x"), (4, "word " * 30_000, "y"), (1, "a b c d e f g h i j", "x"), (5, "é漢 😀\n\n  \t", ""), (None, "no id here", "x"), (None, None, None), (6, "x" * 300, "y"), (7, "x" * 300, "y"), (7, "other text of seven", "y")]
EXTRA = {"size": 1, "copies": "c", "fp": 2.0, "key": 3, "gram": "", "n_words": 0, "toxic": "t", "part": 9, "score": True, "_text": "z", "_id": 4, "curve": 0}


def extra(*without):
    return {k: F.lit(v) for k, v in EXTRA.items() if k not in without}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns(extra())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def filled(sizes, weights, cap):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_targets_and_words(docs):
    rows, texts = mixing.mix(docs).collect(), {r.doc_id: r for r in docs.collect()}
    sizes = Counter()
    for r in rows:
        assert r.size == len(words(texts[r.doc_id].text)) and r.copies in (0, 1, 2, 3) and r.taken == r.copies * r.size
        sizes[r.source] += r.size
    want, took = filled(sizes, (5, 2, 1), 3), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        took[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(took[s] - want[s]) <= largest for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows) and mixing.mix(odd.limit(0)).collect() == []


# 2


def nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]


def test_search_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found, hit, n = defaultdict(list), 0, 0
    for r in ann.search(df).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in np.flatnonzero(ids % 100 == 0):
        got, want = sorted(found[ids[q]]), nearest(ids, x, q)
        assert [g[0] for g in got] == list(range(1, 11)) and [g[2] for g in got] == sorted(g[2] for g in got)
        for _, i, s in got:
            assert s == pytest.approx(float(np.sqrt(((x[ids == i][0] - x[q]) ** 2).sum())), abs=1e-12)
        hit, n = hit + len({g[1] for g in got} & {w[0] for w in want}), n + len(want)
    assert hit >= 0.9 * n


def test_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.1]), (9, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(extra())
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 9)]
    assert ann.search(df.limit(0)).collect() == []


def test_search_ties(spark):
    """A fifth of the rows are equal, some ids repeat, and some rows mirror others at equal distance."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (1500, 4)).astype(float)
    x[::5] = [1, 2, 3, 4]
    x[200::300] = rng.integers(-3, 4, (5, 4))
    x[(x == 0).all(axis=1)] = 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, [9.0] * 4), (100, [9.0] * 4), (300, x[300].tolist())]
    found = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in range(0, 1500, 100):
        point = min((v for i, v in rows if i == q), key=lambda v: np.array(v).tobytes())
        want = sorted((float(np.sqrt(((np.array(v) - point) ** 2).sum())), i) for i, v in {(i, tuple(v)) for i, v in rows} if i != q)[:10]
        assert [(s, i) for _, i, s in sorted(found[q])] == want


def test_search_windows_follow_the_data():
    rng = np.random.default_rng(3)
    spread, near = rng.normal(size=(2000, 32)), rng.normal(size=(100, 32)).repeat(20, axis=0) + 0.01 * rng.normal(size=(2000, 32))
    fit = lambda x: (x.mean(axis=0), float(x.std()))
    (c1, s1), (c2, s2) = ann.windows(spread, fit(spread), 10, 5), ann.windows(near, fit(near), 10, 5)
    assert c2 * s2 < 0.25 < c1 * s1


@given(st.integers(2, 4), st.integers(1, 3))
@settings(max_examples=10, deadline=None)
def test_hilbert_neighbours_touch(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    key = ann.hilbert_keys(cells, bits)
    path = cells[np.argsort(key)]
    assert sorted(key) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# 3


def test_license_statements_and_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", "plain words"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("d/e.txt", "Text. This work is licensed under the GNU General Public License, version 3."),
            ("d/f.txt", None), ("d/g.txt", "The license of my car is old."), (None, ""), ("top.txt", "words " * 20_000), ("a/b/c.txt", "plain words")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, p string, text string").withColumns(extra("_text"))
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(df, path=F.col("p")).collect()}
    assert got == {0: ("MIT", "MIT", None), 1: (None, "Apache-2.0", "a/b"), 2: ("Apache-2.0", "Apache-2.0", None), 3: ("GPL-3.0", "GPL-3.0", None), 4: (None, "GPL-3.0", "d"), 5: (None, "GPL-3.0", "d"), 6: (None, None, None), 7: (None, None, None), 8: (None, "Apache-2.0", "a/b")}
    assert licenses.scan_licenses(df.limit(0), path=F.col("p")).collect() == []


def test_license_filter_loses_nothing(spark):
    idf, vectors, other = licenses.weights()
    for (_, text), v in zip(licenses.TEMPLATES, vectors, strict=True):
        without = " ".join(w for w in text.split() if not re.search("licen[sc]|redistribut", w)).replace("copy of the", "").replace("permission is hereby", "")
        bag = Counter(re.findall(licenses.TOKEN, without))
        x = {w: n * idf.get(w, other) for w, n in bag.items()}
        cosine = sum(x[w] * v.get(w, 0) for w in x) / (sum(y * y for y in x.values()) ** 0.5 or 1)
        assert re.search(r"licen[sc]|copy of the|redistribut|permission is hereby", text) or cosine < licenses.LEAST_COSINE


def test_license_words_left_cannot_match():
    for (name, text), v in zip(licenses.TEMPLATES, licenses.weights()[1], strict=True):
        needed = licenses.needed_words(v)
        left = [w for w in v if w not in needed]
        assert sum(v[w] ** 2 for w in left) ** 0.5 < licenses.LEAST_COSINE, (name, text)  # the cosine of the words left, each as heavy as in the template


def test_license_statements_without_a_licence_word(spark):
    rows = [("This Source Code Form is subject to the terms of the Mozilla Public", "MPL-2.0", 0.905), ("Released under CC BY-NC 4.0", "CC-BY-NC-4.0", 0.814), ("under the MIT", "MIT", 0.837)]
    df = spark.createDataFrame([(i, f"d{i}/x.txt", r[0]) for i, r in enumerate(rows)], "doc_id long, p string, text string")
    got = sorted((r.doc_id, r.own_license, round(r.own_score, 3)) for r in licenses.scan_licenses(df, path=F.col("p")).collect())
    assert got == [(i, name, score) for i, (_, name, score) in enumerate(rows)]


WRAPPED = {
    "BSD-3-Clause": """Copyright (c) 2005, A. Writer
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int main() { return 0; }
""",
    "GPL-3.0": """# This program is free software: you can
# redistribute it and/or modify it under
# the terms of the GNU General Public
# License as published by the Free
# Software Foundation, either version 3 of
# the License, or any later version.
import os
""",
    "MIT": """MIT-style terms

Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction.
""",
    "Apache-2.0": """REM you may not use this file except
REM in compliance with the License.
REM You may obtain a copy of the
REM License at
""",
}


def test_license_of_wrapped_and_unwrapped_texts(spark):
    rows = [(name, f"{name}/{kind}/LICENSE", text if kind == "wrapped" else re.sub(r"\s*\n(?!\n)(REM |[#*/ ]+)?", " ", text)) for name, text in WRAPPED.items() for kind in ("wrapped", "joined")]
    rows += [(name, f"{name}/wrapped/sub/a.txt", "plain words") for name in WRAPPED]
    df = spark.createDataFrame(rows, "doc_id string, p string, text string")
    got = {(r.doc_id, r.path): (r.license, r.own_score) for r in licenses.scan_licenses(df, path=F.col("p")).collect()}
    assert len(got) == len(rows) and all(name == license for (name, _), (license, _) in got.items()), got
    assert all(score >= 0.9 for (_, path), (_, score) in got.items() if path.endswith("LICENSE")), got


def test_license_scan_by_brute_force(spark, docs):
    idf, vectors, other = licenses.weights()

    def own(text):
        best = (0, 0, None)
        for s in re.split(r"\n|(?<=[.;])\s+(?=[A-ZÀ-Þ])", text or ""):
            bag = Counter(re.findall(licenses.TOKEN, s.lower()))
            x = {w: n * idf.get(w, other) for w, n in bag.items()}
            size = sum(y * y for y in x.values()) ** 0.5
            for i, ((name, _), v) in enumerate(zip(licenses.TEMPLATES, vectors, strict=True)):
                score = sum(x[w] * v.get(w, 0) for w in x) / size if size else 0
                if score >= licenses.LEAST_COSINE - 1e-9:
                    best = max(best, (round(score, 9), -i, name))
        return best[2]

    got = {r.doc_id: r.own_license for r in licenses.scan_licenses(docs, path=F.lit("x/y")).collect()}
    assert got == {r.doc_id: own(r.text) for r in docs.collect()} and any(got.values())


# 4


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    mark = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score_toxicity(docs, labels).collect() if r.doc_id in mark]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = Counter((mark[r.doc_id], r.predicted) for r in rows if r.held_out)
    assert held[1, 1] >= 0.9 * (held[1, 1] + held[1, 0]) and held[0, 1] <= 0.01 * (held[0, 1] + held[0, 0])


def test_toxicity_reads_no_held_out_label(docs, labels):
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_odd_rows(odd, labels):
    assert len(toxicity.score_toxicity(odd, labels.withColumns({"text": F.lit("q"), "source": F.lit(1)})).collect()) == len(ODD)
    assert {r.predicted for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0}
    assert toxicity.score_toxicity(odd.limit(0), labels).collect() == []


def test_toxicity_keeps_all_expressions(spark, docs, labels, monkeypatch):
    twice = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    rows = lambda: sorted((r.doc_id or -1, r.score, r.predicted, r.text) for r in toxicity.score_toxicity(twice, labels, carry=("text", "source")).collect())
    whole = rows()
    for most in (1, 7):
        monkeypatch.setattr(toxicity, "EXPRESSIONS", most)
        few = rows()
        assert len(few) == len(whole) and all(a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-6) and a[2:] == b[2:] for a, b in zip(whole, few, strict=True))


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=6).map(lambda x: x + "\0" * (len(x) % 2)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_letters_of_any_words(some):
    word, code = toxicity.grams(some)
    want = []
    for k, w in enumerate(some):
        letters = [0] * toxicity.ORDER + [toxicity.symbol(c) for c in w] + [0]
        want += [(k, sum(letters[i - j] << (toxicity.BITS * j) for j in range(toxicity.ORDER))) for i in range(toxicity.ORDER, len(letters))]
    assert list(zip(word.tolist(), code.tolist(), strict=True)) == want


def test_toxicity_of_texts_with_nul(spark, docs, labels):
    """They are trained on and scored, and change no other text's score in their batch."""
    odd = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\0"), F.replace("text", F.lit("a"), F.lit("a\0")))).otherwise(F.col("text")))
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(odd, labels).collect()}
    one = {r.doc_id: r.score for r in toxicity.score_toxicity(odd.repartition(7), labels).collect()}
    assert len(scored) == docs.count() and all(abs(scored[i] - one[i]) < 1e-9 for i in scored)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    top = np.zeros(toxicity.SYMBOLS**toxicity.ORDER)
    top[rng.integers(0, len(top), 5000)] = rng.integers(1, 9, 5000)
    p = toxicity.interpolate(top, toxicity.backoff(top)).reshape(-1, toxicity.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1)


# 5


def stripped(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def test_strip_repeats(docs):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.strip_repeats(docs).collect())
    assert got == stripped(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_strip_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = queries.QUERIES["op5_strip_repeats"](spark, SF)
    want = con.sql(queries.ORACLES["op5_strip_repeats"])
    assert found.columns == want.columns and sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("length", [30, 100])
def test_strip_splits_frequent_grams(spark, length):
    """One passage between many different neighbours: its gram has more contexts than may meet, so parts and windows do."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7)))
    passage = " ".join(word() for _ in range(24))
    cuts = [passage[rnd.randint(0, 20) : len(passage) - rnd.randint(0, 20)] for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(rnd.randint(0, 9))] + [c] * rnd.randint(1, 2) + [word() for _ in range(rnd.randint(0, 30))])) for i, c in enumerate(cuts)]
    rows += [(100 + i, t) for i, t in rows[:5]]
    got = suffixes.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=length, meet=2).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == stripped(rows, length)


def test_strip_cuts_long_runs():
    """A run that is cut for memory: equal contexts still settle with the first one, and what is left is split."""
    rows = sorted((g, c, k) for g, c, k in [(1, 5, k) for k in range(9)] + [(1, 6, k) for k in range(4)] + [(2, 1, 0), (3, 1, 0), (3, 2, 1)])
    spot = lambda k: (k << 24) | (1 << 12)
    batches = [pa.RecordBatch.from_pydict({"gram": [g], "context": [c], "key": [k], "spot": [spot(k)], "stop": [0]}) for g, c, k in rows]
    out = [r for b in suffixes._sorted_out(iter(batches), 100, 50, held=3) for r in b.to_pylist()]
    assert sorted((r["gram"], r["key"]) for r in out if r["stop"] == -1 and r["gram"] == 1) == [(1, 0), (1, 0)]
    assert sorted(r["key"] for r in out if r["stop"] > 0) == sorted([*range(1, 9), *range(1, 4)])
    assert {(r["gram"], r["key"]) for r in out if r["stop"] <= 0 and r["gram"] == 3} == {(3, 0), (3, 1)}


def test_strip_odd_rows(odd):
    rows = suffixes.strip_repeats(odd, carry=("source",)).collect()
    want = stripped(sorted(((i, t) for i, t, _ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=key) == sorted(want, key=key)
    assert suffixes.strip_repeats(odd.limit(0)).collect() == []


@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=5), st.sampled_from([1, 2, 7, 20, 100]))
@settings(max_examples=60, deadline=None)
def test_merge_equals_sorting(shards, depth):
    data = [np.frombuffer(s, np.uint8) for s in shards]
    rotations = [bytes(np.resize(np.roll(d, -i), depth)) for d in data for i in range(len(d))]
    place, block = bwt.merge(data, depth)
    order = [rotations[i] for i in place]
    assert sorted(place) == list(range(len(rotations))) and order == sorted(order)
    assert [a == b for a, b in zip(order, order[1:], strict=False)] == (np.diff(block) == 0).tolist()


# 6


def printed(text, n=3, distinct=False):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    grams = list(dict.fromkeys(grams)) if distinct else grams
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def component_of(prints, threshold, checks=None, most=64):
    """Of each id the least that links reach, all pairs compared."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= threshold and (checks is None or (checks[a] ^ checks[b]).bit_count() <= most):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("threshold", "reach"), [(2, 2), (2, 1), (4, 2)])
def test_simhash_components(docs, threshold, reach):
    rows = simhash.simhash_components(docs, threshold=threshold, reach=reach).collect()
    prints = {r.doc_id: printed(r.text) for r in docs.collect()}
    assert {r.doc_id: r.fp % 2**64 for r in rows} == prints and {r.doc_id: r.component_id for r in rows} == component_of(prints, threshold)


@pytest.mark.parametrize(("n", "distinct"), [(1, True), (1, False), (2, False), (5, True)])
def test_simhash_of_any_shingles(docs, n, distinct):
    rows = simhash.simhash_prints(docs, "doc_id", "text", n, distinct).collect()
    assert {r.doc_id: r.fp % 2**64 for r in rows} == {r.doc_id: printed(r.text, n, distinct) for r in docs.collect()}


def test_simhash_confirmed_links(docs):
    """Also fingerprints that are equal, while those that confirm them are far apart."""
    more = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 100_000, F.array_join(F.reverse(F.split("text", " ")), " ")))
    rows = simhash.simhash_components(more, words=1, distinct=True, threshold=4, reach=2, confirm=(5, 10)).collect()
    texts = {r.doc_id: r.text for r in more.collect()}
    prints, checks = ({i: printed(t, n, d) for i, t in texts.items()} for n, d in ((1, True), (5, False)))
    assert {r.doc_id: r.component_id for r in rows} == component_of(prints, 4, checks, 10)
    assert any(prints[i] == prints[i + 100_000] and abs(checks[i] - checks[i + 100_000]) > 0 for i in prints if i < 100_000)


def test_simhash_long_runs():
    rng = np.random.default_rng(2)
    near = lambda n: np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, n)).astype(np.uint64), initial=np.uint64(0)) for _ in range(400)], np.uint64)
    prints = np.unique(np.uint64(12345) ^ near(4))
    checks = near(9)[: len(prints)]
    for threshold, reach, most in ((2, 2, 64), (3, 2, 64), (4, 2, 64), (4, 2, 6)):
        anchor, row = simhash.anchors(prints, reach)
        order = np.argsort(anchor, kind="stable")
        batch = pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (anchor, prints[row].view(np.int64), checks[row].view(np.int64))], ["anchor", "fp", "check"])
        out = list(simhash.links(iter([batch]), threshold, reach, most))
        found = [x for b in out for x in zip(b.column(0).to_numpy().view(np.uint64).tolist(), b.column(2).to_numpy().view(np.uint64).tolist(), strict=True)]
        want = component_of({int(p): int(p) for p in prints}, threshold, {int(p): int(c) for p, c in zip(prints, checks, strict=True)}, most)
        root = {int(p): int(p) for p in prints}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in found:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {p: find(p) for p in root} == want and len(found) == len(prints) - len(set(want.values()))


def test_simhash_odd_rows(odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD) and {r.fp for r in rows if r.doc_id in (2, 3)} == {0} and {r.component_id for r in rows if r.doc_id in (2, 3)} == {2}
    assert simhash.simhash_components(odd.limit(0)).collect() == []


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# 7


def test_tool_calls(spark):
    calls = [{"id": "b", "name": "search", "arguments": {"query": "q", "after": {"$ref": "a"}}}, {"id": "a", "name": "calculator", "arguments": {"expression": "1", "more": 2}}, {"id": "c", "name": "nope", "arguments": {}}]
    loop = [{"id": "x", "name": "search", "arguments": {"query": {"$ref": "y"}}}, {"id": "y", "name": "search", "arguments": {"query": {"$ref": "x"}}}]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"tool_calls": calls})), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "r"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "r"})),
            (2, 0, "assistant", json.dumps({"tool_calls": loop})), (3, 0, None, None), (3, 0, "user", "{not json"), (None, None, "user", ""), (3, 1, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(extra("_text"))
    got = sorted(chat.format_chats(df, chat.SCHEMAS).collect(), key=lambda r: (r.conv_id or 0, r.seq))
    one = [(r.kind, r.call_id, r.status) for r in got if r.conv_id == 1]
    assert one == [("message", None, "ok"), ("message", None, "ok"), ("call", "a", "invalid: $.more: unknown"), ("call", "c", "invalid: unknown tool nope"), ("call", "b", "ok"), ("result", "b", "ok"), ("result", "zz", "orphan")]
    assert {r.status for r in got if r.conv_id == 2 and r.kind == "call"} == {"cyclic"}
    assert all(r.json == chat.canonical(json.loads(r.json)) for r in got) and len(got) == 9 + 3 + 2
    assert chat.format_chats(df.limit(0), chat.SCHEMAS).collect() == []


def test_tool_calls_odd_arguments(spark):
    """Deep, broken and non-finite JSON, halves of surrogate pairs, type lists, and references in a null conversation."""
    call = lambda i, arguments: {"id": i, "name": "t", "arguments": arguments}
    ask = lambda *calls: json.dumps({"content": "", "tool_calls": list(calls)})
    said = ask(call("a", "[" * 100_000), call("b", '{"x": NaN}'), call("c", '{"x": "\\ud800"}'), call("d", '{"x": 1e999}'), call("e", '{"x": null}'), call("f", '{"x": 1.5}'))
    rows = [(1, 0, "assistant", said), (None, 0, "assistant", ask(call("q", '{"x": {"$ref": "p"}}'), call("p", "{}"), call("r", '{"x": "\\"$ref\\": \\"q\\""}'))), (None, 1, "tool", json.dumps({"tool_call_id": "q", "content": "\0"}))]
    schema = {"type": "object", "properties": {"x": {"type": ["string", "null", "object"]}}}
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), {"t": schema}).orderBy("conv_id", "seq").collect()
    got = {r.call_id: r.status for r in found if r.conv_id == 1 and r.kind == "call"}
    assert got == {k: "invalid: arguments are no JSON" for k in "abd"} | {"c": "unanswered", "e": "unanswered", "f": "invalid: $.x: not of type string or null or object"}
    assert [json.loads(r.json)["tool_call"]["arguments"] for r in found if r.call_id == "c"] == [{"x": "\ud800"}]
    assert [(r.kind, r.call_id, r.status) for r in found if r.conv_id is None] == [("message", None, "ok"), ("call", "p", "unanswered"), ("call", "r", "unanswered"), ("call", "q", "ok"), ("result", "q", "ok")]


def test_one_long_conversation_is_numbered_in_order(spark):
    rows = [(7, i, "user", f"t{i}") for i in range(5000)] + [(8, 0, "user", "x")]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7), {}).collect()
    assert sorted((r.conv_id, r.seq, r.turn) for r in found) == [(7, i + 1, i) for i in range(5000)] + [(8, 1, 0)]


def test_plain_conversations_keep_every_turn(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    got, want = chat.format_chats(df, {}).collect(), defaultdict(list)
    for r in df.collect():
        want[r.conv_id].append((r.turn, r.role, r.text))
    rows = defaultdict(list)
    for r in sorted(got, key=lambda r: r.seq):
        m = json.loads(r.json)
        rows[r.conv_id].append((r.turn, m["role"], m["content"]))
    assert rows == {k: sorted(v) for k, v in want.items()}


# 8


def counted(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    full = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(inside)


def test_quality(docs, labels):
    texts, mark = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.assess_quality(docs, labels).collect()
    for r in rows:
        n = counted(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n and r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and r.kept == (not r.base_failed and r.probability >= 0.5)
    right = Counter(r.kept == bool(mark[r.doc_id]) for r in rows if r.doc_id in mark and not r.base_failed)
    assert right[True] >= 0.95 * sum(right.values())


def test_quality_odd_rows(odd, labels):
    rows = quality.assess_quality(odd, labels.withColumn("text", F.lit(1))).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(counted(t) for _, t, _ in ODD)
    assert len(quality.assess_quality(odd, labels.limit(0)).collect()) == len(ODD) and quality.assess_quality(odd.limit(0), labels).collect() == []


# 9 and 10


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_bpe_path())


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="aZé' .,!\n\t5ß漢<|endoftext>", max_size=80)), max_size=6))
@settings(max_examples=80, deadline=None)
def test_encoder_equals_library(texts):
    ids, n = tokens.encoder(tokens.word_bpe_path()).encode(pa.array(texts, pa.string()))
    direct = tokens.encoder(tokens.word_bpe_path()).library
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == direct.encode(t or "", add_special_tokens=False).ids
        at += k


@given(st.lists(st.integers(0, 2**32 - 1), max_size=600), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(values, small):
    ids = np.array([v if i % 9 == 0 else v % (1 << small % 33) for i, v in enumerate(values)], np.uint32)
    ids = np.pad(ids, (0, -len(ids) % pfor.BLOCK))
    if len(ids):
        blocks, size = pfor.pack_blocks(ids)
        assert (pfor.unpack_blocks(b"".join(blocks), np.cumsum(size) - size) == ids).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_of_any_file(name):
    import public_tokenizers

    texts = ["Hello  World\n\n it's", None, "", "ÀÉ漢 <|endoftext|> x", "a" * 300]
    one = tokens.Encoder(public_tokenizers.path(name))
    ids, n = one.encode(pa.array(texts))
    want = [one.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert one.quick == (name == "word_bpe_49k.json") and n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_token_files_of_bounded_size(docs):
    """Files end with the document that passes their bound, and orphans of other attempts are removed."""
    scratch = Scratch(docs.sparkSession, "t")
    manifest = pfor.write_token_files(docs, scratch, id_col="doc_id", text_col="text", end_id=2, tokenizer=tokens.word_bpe_path(), file_ids=5000)
    files = manifest.collect()
    assert len(files) > 8 and len(scratch.names("files")) == len(files) and sum(f.n_docs for f in files) == docs.count()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(pfor.read_token_files(manifest, scratch)) == key(pfor.token_files(docs))


def test_quality_sample_is_bounded(docs, labels):
    """Within few bytes no row is learnt from; the counts don't change."""
    few = quality.assess_quality(docs, labels, sample_bytes=1).collect()
    assert {r.probability for r in few} == {0.5} and len(few) == docs.count()


def test_patterns_of_lengths_without_an_exact_fill():
    assert packing.patterns(np.array([1000, 700]), 2048) == [(1000, 1000), (700, 700)]
    slots, n = packing.plan({1000: 5, 700: 4}, 2048)
    assert n == 5 and sum(k * per for _, _, k, per, _ in slots) == 9


def digest(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(which, request, library):
    df = request.getfixturevalue(which)
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), digest(ids)))
        at += len(ids)
    assert sorted((tuple(r) for r in pfor.token_files(df).collect()), key=lambda r: r[1]) == want
    assert pfor.token_files(df.limit(0)).collect() == []


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(which, request, library):
    df = request.getfixturevalue(which)
    held = Counter()
    for r in df.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            held[r.doc_id, k // 2048, k, len(ids[k : k + 2048]), digest(ids[k : k + 2048])] += 1
    rows = packing.pack(df).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == held
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1
    assert packing.pack(df.limit(0)).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=80, deadline=None)
def test_plan_places_every_piece_once(counts):
    slots, n = packing.plan(counts, 64)
    held, room = Counter(), Counter()
    for length, first, number, per, _ in slots:
        held[length] += number * per
        for s in range(first, first + number):
            room[s] += length * per
    assert held == counts and max(room.values(), default=0) <= 64 and len(room) == n


# The pipeline's stages


def test_readable_drops_broken_characters(spark):
    rows = [("aé漢".encode()[:k] + "😀z".encode()[j:],) for k in range(7) for j in range(5)] + [(None,), (b"",)]
    for r in spark.createDataFrame(rows, "kept binary").select("kept", readable("kept").alias("t")).collect():
        assert r.t == (None if r.kept is None else bytes(r.kept).decode("utf-8", "ignore"))


def test_pipeline(spark, docs, labels):
    import corpus_pipeline as cp

    scratch, now, seen = Scratch(spark, "p"), docs, []
    for k, (_, stage) in enumerate(cp.STAGES):
        now = scratch.keep(stage(spark, now, SF), f"s{k}")
        seen.append(now)
    clean = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if r.predicted == 0}
    assert {r.doc_id for r in seen[0].collect()} == clean and seen[0].columns == docs.columns
    comp = {r.doc_id: r.component_id for r in simhash.simhash_components(seen[0], words=1, distinct=True, threshold=4, reach=2, confirm=(5, 10)).collect()}
    assert {r.doc_id for r in seen[1].collect()} == set(comp.values())
    want = {i: kept for i, _, _, _, kept in stripped(sorted((r.doc_id, r.text) for r in seen[1].collect()))}
    for r in seen[2].collect():
        assert r.text == want[r.doc_id].decode("utf-8", "ignore") and r.n_chars == len(r.text)
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[2]).collect() if r.copies}
    assert Counter(r.doc_id for r in seen[3].collect()) == Counter(copies)
    assert sum(r.length for r in now.collect()) == sum(r.n_tokens for r in pfor.token_files(seen[3]).collect())


def test_pipeline_odd_rows(spark, odd):
    """Nulls, empty, long and repeated rows, and clashing columns come through each stage; an empty table stays empty."""
    import corpus_pipeline as cp

    rows = odd.withColumns({"lang": F.lit("x"), "n_chars": F.length("text").cast("long")})
    scratch, now, seen = Scratch(spark, "p"), rows, []
    for k, (_, stage) in enumerate(cp.STAGES):
        now = scratch.keep(stage(spark, now, SF), f"s{k}")
        seen.append(now)
        assert k == 4 or tuple(now.columns) == cp.COLUMNS
    assert seen[0].count() == len(ODD)
    ids = Counter(r.doc_id for r in seen[1].collect())
    assert ids[None] == 2 and ids[1] == 2 and ids[2] + ids[3] == 1
    assert all(r.text for r in seen[3].collect()) and now.count() >= seen[3].count()
    for k, (_, stage) in enumerate(cp.STAGES):
        assert stage(spark, rows.limit(0), SF).collect() == []
