"""Hard negatives, bit-sliced search and importance resampling against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import bitsliced, negatives, resampling
from siltstone.llm.vectors import narrow

SCHEMA = "vec_id long, embedding array<float>, label int"
INF, NAN = float("inf"), float("nan")


def vectors(n, dims=8, labels=3, seed=1, wide=1.0):
    rng = random.Random(seed)
    return [(i, [rng.choice([-1, 1]) * rng.random() * wide for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


#: No part: null id, vector, component; non-finite ones; an empty vector. Another length; a repeated row; an id with two vectors; equal vectors.
ODD = [(None, [0.5] * 8, 1), (900, None, 1), (901, [0.5] * 7 + [None], 1), (902, [NAN] + [0.5] * 7, 0), (903, [0.5] * 7 + [INF], 2), (904, [], 1), (905, [0.25, 0.5], 1), (910, [0.25, -0.5], 1),
       (50, [0.5] * 8, 1), (50, [0.5] * 8, 1), (51, [0.0] * 8, 2), *[(1000 + i, [0.75] * 8, 1) for i in range(40)], *[(1100 + i, [0.25] * 8, 2) for i in range(40)]]


def whole(rows, scale=256):
    """Distinct (id, label, quantised vector) of rows that take part."""
    out = set()
    for i, v, label in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            out.add((i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    return sorted(out, key=repr)


def asks(rows, every, key):
    least = {}
    for r in rows:
        if r[0] % every == 0 and (r[0] not in least or key(r) < key(least[r[0]])):
            least[r[0]] = r
    return list(least.values())


def dot(x, y):
    return sum(a * b for a, b in zip(x, y, strict=True))


def raw(q):
    return np.array(q, "<i8").tobytes()


def mined(rows, every, positives, negatives_, low, high):
    out = set()
    for a in asks(rows, every, lambda r: (len(r[2]), r[1], raw(r[2]))):
        near = [(dot(a[2], r[2]), r[0], r[1]) for r in rows if r[0] != a[0] and len(r[2]) == len(a[2])]
        first = sorted((-s, i) for s, i, label in near if label == a[1])[:positives]
        for s, i in set(first):
            window = sorted((-n, j) for n, j, label in near if label != a[1] and low * -s <= 100 * n <= high * -s)
            out |= {(a[0], i, k + 1, j, -s, -n) for k, (n, j) in enumerate(window[:negatives_])}
    return out


@pytest.mark.parametrize("size,chunk,anchors", [(16, 3, 2), (4096, 32, 64)])
def test_hard_negatives(spark, size, chunk, anchors):
    rows = vectors(150) + [r for r in ODD if r[0] != 1000] + [(7, [0.1] * 8, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"a": F.lit(1), "dims": F.lit("x"), "part": F.lit(0), "asks": F.lit(True)})
    got = negatives.mine(df, every=10, size=size, chunk=chunk, anchors=anchors).collect()
    held = [r for r in whole(rows) if r[1] is not None]
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == mined(held, 10, 5, 10, 30, 90)


def test_hard_negatives_of_few_rows_and_wide_values(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mine(spark.createDataFrame([(100, [0.5], 1)], SCHEMA)).count() == 0
    rows = [(0, [3e6, 2e6], 1), (1, [1.5e6, 1e6], 1), (2, [1e6, 5e5], 2), (3, [1.0, 1.0], 2), (4, [-1e6, 1.0], 2)]
    got = {tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got and got == mined(whole(rows), 100, 5, 10, 30, 90)


@pytest.mark.parametrize("block,group", [(64, 3), (8192, 256)])
def test_bit_sliced_search(spark, block, group):
    rows = vectors(200) + ODD + [(100, [-0.5] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit(1), "group": F.lit("x"), "rank": F.lit(0), "query_id": F.lit(3)})
    got = bitsliced.search(df, block=block, group=group).collect()
    held = sorted({(i, None, q) for i, _, q in whole(rows)}, key=repr)
    want = []
    for a in asks(held, 50, lambda r: (len(r[2]), raw(r[2]))):
        near = sorted((-dot(a[2], r[2]), r[0]) for r in held if r[0] != a[0] and len(r[2]) == len(a[2]))
        want += [(a[0], k + 1, i, -s) for k, (s, i) in enumerate(near[:5])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_bit_sliced_search_of_few_rows(spark):
    assert bitsliced.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert bitsliced.search(spark.createDataFrame([(50, [0.5], 1)], SCHEMA)).count() == 0
    got = bitsliced.search(spark.createDataFrame([(50, [0.5], 1), (1, [-0.5], 1), (2, [0.0], 1)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(50, 1, 2, 0), (50, 2, 1, -128 * 128)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(1, 6), st.integers(0, 62), st.integers(0, 2**32), st.integers(1, 9))
def test_sums_of_slices(n, dims, bits, seed, k):
    rng = np.random.default_rng(seed)
    x = rng.integers(-(1 << bits), (1 << bits) + 1, (n, dims))
    q = rng.integers(-(1 << bits), (1 << bits) + 1, dims)
    least, wide, bitmaps = bitsliced.slices(x)
    constant, sums = bitsliced.add(q, least, wide, np.concatenate([bitmaps, ~bitmaps]))
    want = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    assert [constant + sum((int(s[i // 64]) >> (i % 64) & 1) << w for w, s in enumerate(sums)) for i in range(n)] == want
    every = np.packbits(np.arange(len(bitmaps[0]) * 64 if len(bitmaps) else -(-n // 64) * 64) < n, bitorder="little").view("<u8")
    assert sorted(bitsliced.top(sums, every, k).tolist()) == sorted(sorted(range(n), key=lambda i: (-want[i], i))[:k])


def test_narrowest_type():
    for top, kind in ((127, "<i1"), (128, "<i2"), (1 << 20, "<i4"), (1 << 40, "<i8")):
        assert narrow(np.array([[-1, top]]))[0] == kind


# Resampling


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text):
    w = cut(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def found(texts):
    out = [[] for _ in texts]
    for _, text, bucket in resampling.features(*resampling.buffers(texts)):
        for t, b in zip(text.tolist(), bucket.tolist(), strict=True):
            out[t].append(b)
    return [sorted(x) for x in out]


ALPHABET = "aZ09 \n-_é漢😀\x00\x7f'."


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=40)), max_size=8), st.integers(0, 3))
def test_features_of_texts(texts, skip):
    want = [sorted(grams(t)) for t in texts]
    assert found(pa.array(texts, pa.string())) == want
    assert found(pa.array(texts, pa.string()).slice(skip)) == want[skip:]


@pytest.mark.parametrize("starts,steps", [(1 << 19, 96), (3, 2)])
def test_features_over_portions_and_long_words(monkeypatch, starts, steps):
    monkeypatch.setattr(resampling, "STARTS", starts)
    monkeypatch.setattr(resampling, "STEPS", steps)
    texts = ["ab cd ef gh ij", "x" * 95 + " " + "y" * 96 + " " + "Z" * 97 + " " + "w" * 5000, None, "", "last words"]
    assert found(pa.array(texts)) == [sorted(grams(t)) for t in texts]


def test_crc_steps_are_the_usual_ones():
    state = 0xFFFFFFFF
    for byte in b"any bytes \xff\x00":
        state = int(resampling.CRC[(state ^ byte) & 0xFF]) ^ state >> 8
    assert state ^ 0xFFFFFFFF == zlib.crc32(b"any bytes \xff\x00")


def resampled(docs, target, share, least):
    have, want = Counter(), Counter()
    for _, t in docs:
        have.update(grams(t))
    for t in target:
        want.update(grams(t))
    s, t = sum(have.values()) + 10_000, sum(want.values()) + 10_000
    rows = []
    for i, text in docs:
        weight = sum(math.floor(1000 * math.log((want[b] + 1) * s / ((have[b] + 1) * t))) for b in grams(text))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(grams(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(cut(text)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: share * len(order) // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in order[len(drawn) :]] + [(*r[:4], None) for r in rows if not r[4]])


def test_resampling(spark):
    rng = random.Random(3)
    some = ["alpha", "Beta", "gamma", "delta", "é", "ten10", "end"]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randrange(1, 40)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "word " * 20_000), (204, "x" * 100_000), (5, docs[5][1]), (None, docs[7][1]), (None, None)]
    target = ["alpha beta gamma " * 5, None, "", "end end"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"bucket": F.lit(1), "weight": F.lit("x"), "_m": F.lit(0), "rank": F.lit(2), "n": F.lit(1)})
    got = resampling.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, n int"), share=30, least_words=10).drop("n_words")
    assert Counter(tuple(r) for r in got.collect()) == resampled(docs, target, 30, 10)


def test_resampling_of_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert Counter(tuple(r) for r in resampling.resample(some, target, share=100).drop("n_words").collect()) == resampled([(1, "a b c " * 10)], [], 100, 20)
