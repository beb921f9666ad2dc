"""Quality rules: base counts, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch, by_batch, load

#: Hash buckets of the n-grams, words of a repeated window, bytes of a character n-gram.
BUCKETS, WINDOW, CHARS = 1 << 18, 5, 4
#: At most so many labelled documents, and so many bytes of them, train the model, those of least hash of the id; every fifth of them
#: calibrates instead.
SAMPLE, SAMPLE_BYTES = 4000, 64 << 20
#: Fixed thresholds: least number of words, most percent of words in repeated windows, least probability of label 1.
LEAST_WORDS, MOST_REPEATED, LEAST_PROBABILITY = 10, 20, 0.5
#: Characters that count as symbols: fixed values.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Texts:
    """A batch's texts as bytes in a row, and their words as numbers. Null: empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets, self.column = offsets - offsets[0], column
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        before = np.concatenate([[True], space[:-1]]) if len(space) else space
        before[self.offsets[:-1][self.offsets[:-1] < len(space)]] = True
        self.space, begin = space, ~space & before
        self.n_words = self.total(begin)
        start = np.flatnonzero(begin)
        after = np.concatenate([space[1:], [True]]) if len(space) else space
        inner = self.offsets[1:][(self.offsets[1:] > 0)] - 1
        after[inner] = True
        stop = np.flatnonzero(~space & after) + 1
        raw = self.data.tobytes()
        words = pa.array([raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())
        coded = words.dictionary_encode()
        self.words, self.vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def total(self, per_byte: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])[self.offsets])


def mixed(*parts: np.ndarray) -> np.ndarray:
    """64-bit hash of numbers in order."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    """The counts named in COUNTS, by text."""
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    lines = np.zeros(len(t.n_words), np.int64)
    for i, text in enumerate(t.column.to_pylist()):
        filled = [x for x in text.split(b"\n") if x.strip()]
        lines[i] = len(filled) - len(set(filled))
    repeat = np.zeros(len(t.words) + 1, np.int32)
    n = len(t.words) - WINDOW + 1
    if n > 0:
        whole = np.flatnonzero(t.doc[:n] == t.doc[WINDOW - 1 :])
        key = mixed(t.doc[whole], *(t.words[whole + k] for k in range(WINDOW)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = whole[order[twice[: len(order)]]] if len(order) else whole
        np.add.at(repeat, at, 1)
        np.add.at(repeat, at + WINDOW, -1)
    inside = np.cumsum(repeat[:-1]) > 0
    return {
        "n_words": t.n_words,
        "word_chars": t.total(~t.space & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.total(table[t.data]),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(t.doc, inside, len(t.n_words)).astype(np.int64),
    }


def hashed(t: Texts) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """((bucket, text) of words and word pairs, the same of character n-grams)."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in t.vocabulary), np.uint64, len(t.vocabulary))[t.words] if len(t.words) else np.zeros(0, np.uint64)
    pair = t.doc[1:] == t.doc[:-1]
    two = mixed(h[:-1][pair], h[1:][pair])
    word = (np.concatenate([mixed(h), two]) >> np.uint64(46)).astype(np.int64), np.concatenate([t.doc, t.doc[:-1][pair] if len(t.doc) else t.doc])
    n = len(t.data) - CHARS + 1
    if n <= 0:
        return word, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    size = np.diff(t.offsets)
    whole = np.ones(len(t.data), bool)
    for k in range(1, CHARS):  # grams that reach into the next text
        at = t.offsets[1:] - k
        whole[at[(at >= 0) & (at >= t.offsets[:-1])]] = False
    padded = np.concatenate([t.data, np.zeros(8, np.uint8)])
    code = np.ndarray(n, "<u4", padded, 0, (1,)) * np.uint32(0x9E3779B1)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)[:n]
    return word, ((code >> np.uint32(14)).astype(np.int32)[whole[:n]], doc[whole[:n]])


def scores(t: Texts, model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    """Log-odds before calibration: mean weight of a text's word n-grams plus that of its character n-grams, plus the bias."""
    out = np.full(len(t.n_words), model[2])
    for (bucket, doc), w in zip(hashed(t), model[:2], strict=True):
        n = np.bincount(doc, minlength=len(out))
        out += np.bincount(doc, w[bucket], len(out)) / np.maximum(n, 1)
    return out


def shares(texts: pa.Array, step: int = 100) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of n-gram: (bucket, text, share of the text's n-grams), worked out a few texts at a time."""
    found: list[list[tuple]] = [[], []]
    for a in range(0, len(texts), step):
        t = Texts(texts.slice(a, step))
        for kind, (bucket, doc) in zip(found, hashed(t), strict=True):
            key, count = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            doc = key // BUCKETS
            n = np.bincount(doc, count, step)
            kind.append(((key % BUCKETS).astype(np.int32), (doc + a).astype(np.int32), (count / n[doc]).astype(np.float32)))
    return [tuple(np.concatenate(x) for x in zip(*kind, strict=True)) for kind in found]


def train(texts: pa.Array, y: np.ndarray, rounds: int = 120, rate: float = 2.0, decay: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch AdaGrad; word and character features are shares of a text's n-grams."""
    if not len(texts):
        return np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0
    grams = shares(texts)
    weights, past, bias = [np.zeros(BUCKETS) for _ in grams], [np.full(BUCKETS, 1e-12) for _ in grams], 0.0
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    for _ in range(rounds):
        z = bias + sum(np.bincount(d, w[b] * v, len(y)) for (b, d, v), w in zip(grams, weights, strict=True))
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        bias -= float(slope.sum())
        for (b, d, v), w, g2 in zip(grams, weights, past, strict=True):
            g = np.bincount(b, slope[d] * v, BUCKETS) + decay * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
    return weights[0].astype(np.float32), weights[1].astype(np.float32), bias


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of Platt's logistic calibration, with his smoothed aims; no labels: as they are."""
    if not len(y):
        return 1.0, 0.0
    aim = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w, x = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (aim - p) - 1e-4 * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def assess_quality(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per row of df: doc_id, the counts, base_failed, probability (of label 1), kept.

    Words are runs of anything but ASCII white space. base_failed: fewer than 10 words, or over 20 % of the words in 5-word
    windows that the text holds twice or more. kept: not base_failed, and a probability of at least 0.5. The model is fitted on
    at most `sample` labelled rows, whole texts of `sample_bytes` together at most, which come to the driver; all counts and scores
    are of whole texts of all rows, in Arrow batches.

    Null or empty texts: no words, base_failed. Rows that repeat an id are rows of their own and share its label (the smallest,
    if they differ). Null ids are scored, not learnt from. Without labels the probability is 0.5. Extra columns are ignored.
    """
    spark = df.sparkSession
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    few = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(sample))  # bounded
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(few, "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))
    taken = None
    if not few.isEmpty():
        rows = Scratch(spark, "quality").keep(rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "sample")
        so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("_id"), "_id"))  # of `sample` rows at most
        ids = rows.select("_id", "bytes").withColumn("so_far", so_far).filter(F.col("so_far") <= sample_bytes).select("_id")
        taken = rows.join(F.broadcast(ids), "_id", "left_semi").drop("bytes").orderBy(F.xxhash64("_id"), "_id").toArrow()
    model, slope, offset = (np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0), 1.0, 0.0
    if taken is not None and taken.num_rows:
        y, texts = taken.column("y").to_numpy().astype(float), taken.column("text").combine_chunks()
        held = np.arange(len(y)) % 5 == 4
        model = train(texts.filter(pa.array(~held)), y[~held])
        if held.any():
            slope, offset = calibrate(scores(Texts(texts.filter(pa.array(held))), model), y[held])
    shared = spark.sparkContext.broadcast(model)

    def assess(b: pa.RecordBatch) -> pa.RecordBatch:
        t = Texts(b.column(1))
        counts = base_counts(t)
        p = 1 / (1 + np.exp(-np.clip(slope * scores(t, shared.value) + offset, -30, 30)))
        failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * counts["n_words"])
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= LEAST_PROBABILITY))], ["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(by_batch(assess), f"doc_id {kind}, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, probability double, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
