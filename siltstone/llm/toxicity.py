"""Toxicity by class-conditional Kneser-Ney models over the letters of words."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, by_batch, load, partitions

#: Symbols of the model: 0 word border, 1-26 a-z (accents dropped), 27 digit, 28 other Latin letter, 29 other letter, 30 mark or sign, 31 punctuation.
SYMBOLS, BITS = 32, 5
#: Letters of an expression that the model sees at once; so the tables have SYMBOLS ** ORDER cells at most, whatever the corpus.
ORDER, DISCOUNT = 4, 0.75
#: Letters of the word beginnings that count as expressions of their own; toxic documents one must stand in; most that workers hold, the
#: others are joined; bits of the filter of those.
BEGINNINGS, LEAST_TOXIC, EXPRESSIONS, FILTER = range(3, 11), 2, 1 << 17, 1 << 26
#: At most so many labelled documents calibrate the score, those of least hash of the id.
CALIBRATION = 4000
THRESHOLD, FEATURES, NEVER = 0.3, 5, -9.0
#: Ratios beyond this are summed.
HIGH = 3
#: Log-odds of any text where there are no labels.
NO_LABELS = -4.6
#: Remainders of crc32(id) modulo 4 whose labels may be learnt.
FOLDS = (0, 1, 3)


def symbol(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    kind = unicodedata.category(char)
    if kind[0] == "N":
        return 27
    if kind[0] == "L":
        base = unicodedata.normalize("NFD", char)[0]
        return ord(base) - 96 if "a" <= base <= "z" else 28 if ord(char) < 0x250 else 29
    return 31 if kind[0] == "P" else 30


class Alphabet(dict):
    def __missing__(self, code: int) -> int:
        self[code] = found = symbol(chr(code))
        return found


ALPHABET = Alphabet()


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(lower-cased words of all texts in a row, trimmed of ASCII punctuation; number of words of each text). Null: none."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    cut = pc.utf8_split_whitespace(lower)
    flat = pc.utf8_trim(cut.flatten(), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(some)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
    return flat.filter(pa.array(some)).dictionary_encode(), np.diff(ends)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, code of the ORDER letters that end at each of its letters and its end); before the word are borders."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.fromiter(map(len, words), np.int64, len(words))
    unique, back = np.unique(points, return_inverse=True)
    at = np.arange(len(points)) + np.repeat(np.arange(len(words)), length)  # a border, of code 0, follows each word
    code, end = np.zeros(len(points) + len(words), np.int64), np.ones(len(points) + len(words), bool)
    code[at], end[at] = np.array([ALPHABET[int(u)] for u in unique], np.int64)[back], False
    word = np.repeat(np.arange(len(words)), length + 1)
    out = code.copy()
    alive = np.ones(len(code), bool)
    for k in range(1, ORDER):
        alive[k:] &= ~end[: len(end) - k] if k < len(end) else True
        alive[:k] = False
        out[k:] |= np.where(alive[k:], code[: len(code) - k], 0) << (BITS * k)
    return word, out


def backoff(top: np.ndarray) -> np.ndarray:
    """Shared probabilities P(letter | ORDER - 2 letters before) of order ORDER - 1, from continuation counts of both classes.

    top: counts of both classes by code. Each lower order counts how many different letters come before (Kneser-Ney), and is
    interpolated with the next lower one, down to even chances.
    """
    seen = (top > 0).reshape(SYMBOLS, -1).sum(axis=0).astype(np.float64)  # distinct letters before each shorter code
    levels = [seen]
    for _ in range(ORDER - 2):
        levels.append((levels[-1] > 0).reshape(SYMBOLS, -1).sum(axis=0).astype(np.float64))
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for level in reversed(levels):
        p = interpolate(level, p)
    return p


def interpolate(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Absolute discounting of counts by code, the rest shared out by the lower order; unseen contexts are the lower order."""
    c = counts.reshape(-1, SYMBOLS)
    total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
    low = np.tile(lower.reshape(-1, SYMBOLS), (len(c) // (len(lower) // SYMBOLS), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(total > 0, np.maximum(c - DISCOUNT, 0) / total + DISCOUNT * kinds / total * low, low)
    return p.ravel()


def ratios(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(letter | before, toxic) - log P(letter | before, ordinary) by code."""
    shared = backoff(toxic + ordinary)
    return (np.log(interpolate(toxic, shared)) - np.log(interpolate(ordinary, shared))).astype(np.float32)


class Model:
    """Log-likelihood ratios of letters by code, and of expressions (word beginnings) by length."""

    def __init__(self, table: np.ndarray, expressions: list[str], ratio: np.ndarray):
        self.table, self.by_length = table, {}
        size = np.array([len(e) for e in expressions], np.int64)
        for k in np.unique(size).tolist():
            mine = np.flatnonzero(size == k)
            self.by_length[k] = pa.array([expressions[i] for i in mine], pa.large_string()), np.append(ratio[mine], NEVER)

    def best(self, words: pa.Array) -> np.ndarray:
        """Largest ratio of an expression that a word begins with."""
        out = np.full(len(words), NEVER)
        for k, (known, ratio) in self.by_length.items():
            at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(words, 0, k), known), -1).to_numpy()
            out = np.maximum(out, ratio[at])
        return out


def expression_ratios(toxic: np.ndarray, ordinary: np.ndarray, kinds: tuple[np.ndarray, np.ndarray, np.ndarray], n: tuple[float, float]) -> np.ndarray:
    """Log-likelihood ratio of expressions from the number of documents of each class; discounts go to a shared even chance
    over all expressions of that length. kinds: how many the toxic, the ordinary and both classes have of each length."""
    shared = 1 / np.maximum(kinds[2], 1)
    p = [np.maximum(c - DISCOUNT, 0) + DISCOUNT * k * shared for c, k in ((toxic, kinds[0]), (ordinary, kinds[1]))]
    out = np.log(np.maximum(p[0], 1e-9) / max(n[0], 1)) - np.log(np.maximum(p[1], 1e-9) / max(n[1], 1))
    return np.where(toxic >= LEAST_TOXIC, out, NEVER)


def features(texts: pa.Array, model: Model) -> np.ndarray:
    """Per text: log-likelihood ratio per letter of the whole text; largest ratio of a word's letters, and sum of high ones by
    the root of the number of words; the same two of expressions."""
    words, n = words_of(texts)
    out = np.zeros((len(n), FEATURES))
    if not len(words):
        return out
    word, code = grams(words.dictionary.to_pylist())
    ratio, size, best = np.bincount(word, model.table[code]), np.bincount(word), model.best(words.dictionary)
    at, doc = words.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
    some = n > 0
    begin = (np.cumsum(n) - n)[some]
    out[some, 0] = np.bincount(doc, ratio[at], len(n))[some] / np.bincount(doc, size[at], len(n))[some]
    for k, x in ((1, ratio), (3, best)):
        out[some, k] = np.maximum.reduceat(x[at], begin)
        out[some, k + 1] = np.add.reduceat(np.maximum(x[at] - HIGH, 0), begin) / np.sqrt(n[some])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights of (1, x) with a small ridge by Newton's method, steps halved until the loss falls; one class only: its smoothed share."""
    w = np.zeros(x.shape[1] + 1)
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not 0 < y.sum() < len(y):
        return w
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.concatenate([np.ones((len(x), 1)), x / scale], axis=1)
    pull = ridge * np.append(0.0, np.ones(x.shape[1]))
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + pull @ (w * w) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (y - p) - pull * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w / np.append(1.0, scale)


CELLS = range(2 * len(FOLDS))
KINDS = "".join(f", c{c} long, d{c} long" for c in CELLS)


def word_counts(labelled: DataFrame) -> DataFrame:
    """(text, cell) -> (word, c0, d0, ... c5, d5): by cell (fold times two, plus class) how often it occurs, and in how many texts.
    Combined in a batch first."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        words, n = words_of(b.column(0))
        at, k, doc = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary)), np.repeat(np.arange(len(n)), n)
        once = np.unique(doc * k + at)
        cell, cell_once = np.repeat(b.column(1).to_numpy(), n), b.column(1).to_numpy()[once // k]
        counts = [np.bincount(x[y == c], minlength=k)[: len(words.dictionary)] for c in CELLS for x, y in ((at, cell), (once % k, cell_once))]
        return pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), *map(pa.array, counts)], ["word", *_names()])

    return labelled.select("text", "cell").mapInArrow(by_batch(count), "word string" + KINDS).groupBy("word").agg(*_sums())


def _names() -> list[str]:
    return [f"{x}{c}" for c in CELLS for x in "cd"]


def _sums() -> list:
    return [F.sum(c).alias(c) for c in _names()]


def gram_counts(words: DataFrame) -> DataFrame:
    """(code, c0, ... c5) of the letters of words."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(CELLS), SYMBOLS**ORDER), np.int64)
        for b in batches:
            if b.num_rows:
                word, code = grams(b.column(0).to_pylist())
                for c in CELLS:
                    total[c] += np.bincount(code, b.column(f"c{c}").to_numpy()[word], SYMBOLS**ORDER).astype(np.int64)
        code = np.flatnonzero(total.any(axis=0))
        if len(code):
            yield pa.RecordBatch.from_arrays([pa.array(code), *(pa.array(x[code]) for x in total)], ["code", *(f"c{c}" for c in CELLS)])

    return words.mapInArrow(spell, "code long" + "".join(f", c{c} long" for c in CELLS)).groupBy("code").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in CELLS))


def expression_counts(words: DataFrame) -> DataFrame:
    """(word, k, d0, ... d5, edge) of word beginnings that toxic texts hold, k = 0; and a row of each length k, whose d0, d1, d2 are
    how many beginnings the ordinary, the toxic and both classes have besides those with an edge. Words come sorted by range,
    so that a beginning's words lie together and are summed where they are; only those at the edge of a batch meet again."""

    def begin(b: pa.RecordBatch) -> pa.RecordBatch:
        words = b.column(0).cast(pa.large_string())
        counts = np.stack([b.column(1 + c).to_numpy() for c in CELLS])
        length, found, kind, sums = pc.utf8_length(words).to_numpy(), [], [], []
        for k in BEGINNINGS:
            coded = pc.utf8_slice_codeunits(words.filter(pa.array(length >= k)), 0, k).dictionary_encode()
            total = np.stack([np.bincount(coded.indices.to_numpy(), x[length >= k], len(coded.dictionary)) for x in counts]).astype(np.int64)
            ordinary, toxic = total[0::2].sum(axis=0), total[1::2].sum(axis=0)
            edge = np.zeros(len(toxic), bool)
            if len(toxic):
                edge[[0, -1]] = True
            keep = (toxic > 0) | edge
            found += [coded.dictionary.filter(pa.array(keep)), pa.array([""], pa.large_string())]
            kind += [0] * int(keep.sum()) + [k]
            inner = [((x > 0) & ~edge).sum() for x in (ordinary, toxic, ordinary + toxic)]
            sums += [np.concatenate([total[:, keep], [edge[keep]]]), np.array([[*inner, 0, 0, 0, 0]]).T]
        sums = np.concatenate(sums, axis=1).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(found).cast(pa.string()), pa.array(kind, pa.int32()), *map(pa.array, sums)], ["word", "k", *names])

    names = [*(f"d{c}" for c in CELLS), "edge"]
    kinds = "".join(f", {c} long" for c in names)
    ranged = words.select("word", *names[:-1]).repartitionByRange(partitions(words.sparkSession), "word").sortWithinPartitions("word")
    return ranged.mapInArrow(by_batch(begin), "word string, k int" + kinds).groupBy("word", "k").agg(*(F.sum(c).alias(c) for c in names))


def _models(grams_: DataFrame, expressions: DataFrame, words: DataFrame, scratch: Scratch) -> tuple[list[Model], DataFrame | None]:
    """A model without each fold, and one of all, and what they leave out: (word, ratios by model) of the expressions beyond
    the first EXPRESSIONS, or None if there are none. At most SYMBOLS ** ORDER and EXPRESSIONS rows come to the driver."""
    rows, folds = grams_.toPandas(), len(FOLDS)
    total = np.zeros((folds, 2, SYMBOLS**ORDER))
    total.reshape(2 * folds, -1)[:, rows["code"].to_numpy()] = rows.drop(columns="code").to_numpy().T
    n = np.array([x or 0 for x in words.agg(*(F.sum(f"d{c}") for c in CELLS)).first()], float).reshape(folds, 2)
    toxic, ordinary = (sum((F.col(f"d{c}") for c in CELLS if c % 2 == i), F.lit(0)) for i in (1, 0))
    total_row = F.col("k") > 0
    inner = expressions.filter(total_row).select("k", "d1", "d0", "d2")
    edges = expressions.filter(~total_row & (F.col("edge") > 0)).select(F.length("word").alias("k"), (toxic > 0).cast("long"), (ordinary > 0).cast("long"), F.lit(1).cast("long"))
    size = {r.k: (r.d1, r.d0, r.d2) for r in inner.union(edges).groupBy("k").agg(*(F.sum(c).alias(c) for c in ("d1", "d0", "d2"))).collect()}
    less = lambda x, i: x.sum(axis=0) - (0 if i is None else x[i])
    each = [*range(folds), None]

    def weigh(b: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.stack([b.column(1 + c).to_numpy() for c in CELLS]).astype(float).reshape(folds, 2, -1)
        kinds = tuple(np.array([size[k][i] for k in pc.utf8_length(b.column(0)).to_pylist()], float) for i in range(3))
        found = []
        for i in each:
            documents, m = less(counts, i), less(n, i)
            found.append(expression_ratios(documents[1], documents[0], kinds, (m[1], m[0])))
        found = np.where(np.array(found) > 0, found, NEVER)  # the others are never a word's best
        out = pa.RecordBatch.from_arrays([b.column(0), pa.array(counts[:, 1].sum(axis=0).astype(np.int64)), *map(pa.array, found)], ["word", "toxic", *ratio_names])
        return out.filter(pa.array((found > 0).any(axis=0)))

    ratio_names = [f"r{i}" for i in range(len(each))]
    held = expressions.filter(~total_row & (toxic >= LEAST_TOXIC)).select("word", *(f"d{c}" for c in CELLS))
    high = scratch.keep(held.mapInArrow(by_batch(weigh), "word string, toxic long" + "".join(f", {c} double" for c in ratio_names)), "ratios")
    first = high.orderBy(F.desc("toxic"), "word").limit(EXPRESSIONS).toPandas()
    rest = None
    if len(first) == EXPRESSIONS:
        last, word = int(first["toxic"].iloc[-1]), first["word"].iloc[-1]
        rest = high.filter((F.col("toxic") < last) | ((F.col("toxic") == last) & (F.col("word") > word))).select("word", F.array(*ratio_names).alias("ratios"))
        rest = None if rest.isEmpty() else rest
    out = []
    for i, name in zip(each, ratio_names, strict=True):
        letters, some = less(total, i), first[name] > 0
        out.append(Model(ratios(toxic=letters[1], ordinary=letters[0]), first["word"][some].tolist(), first[name][some].to_numpy(dtype=float)))
    return out, rest


def _bits(words: np.ndarray) -> np.ndarray:
    """Place in the filter of each word."""
    return (pd.util.hash_array(words.astype(object), categorize=False) % np.uint64(FILTER)).astype(np.int64)


def filter_of(rest: DataFrame) -> np.ndarray:
    """FILTER bits in bytes, those of the words set; it grows with no input."""
    place = rest.select("word").mapInArrow(by_batch(lambda b: pa.RecordBatch.from_arrays([pa.array(_bits(b.column(0).to_numpy(zero_copy_only=False)) + 1)], ["at"])), "at long")
    packed = place.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(FILTER // 8, np.uint8)
    for r in packed.collect():
        out[(r.k - 1) * len(r.bits) : r.k * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def joined_part(rows: DataFrame, models, bits, rest: DataFrame) -> DataFrame:
    """What the expressions that workers don't hold add: (k1, k2, model) -> (top, more), the largest ratio of one, and by how much
    the sum of high ones grows. rows: k1, k2 (hashes of the text), model, text; those that repeat a text count once.

    models and bits are broadcast variables. Word beginnings that may be in rest, as the filters tell, are joined with it. Those
    of ratio HIGH at most change no sum, and no largest ratio of a text that has a higher one already; they are left out there.
    """

    def begin(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        for m in np.unique(b.column(2).to_numpy()).tolist():
            mine = np.flatnonzero(b.column(2).to_numpy() == m)
            words, n = words_of(b.column(3).take(pa.array(mine)))
            if not len(words):
                continue
            size = len(words.dictionary)
            length, best = pc.utf8_length(words.dictionary).to_numpy(), models.value[m].best(words.dictionary)
            pair, times = np.unique(np.repeat(np.arange(len(n)), n) * size + words.indices.to_numpy(), return_counts=True)
            row, word = mine[pair // size], pair % size
            top = np.full(len(n), NEVER)
            np.maximum.at(top, pair // size, best[word])
            low = top < HIGH
            for k in BEGINNINGS:
                begins = pc.utf8_slice_codeunits(words.dictionary, 0, k)
                at = _bits(begins.to_numpy(zero_copy_only=False))
                any_, high = ((length >= k) & ((x[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0) for x in bits.value)
                keep = np.flatnonzero(high[word] | (any_[word] & low[pair // size]))
                w = pa.array(word[keep])
                found.append([b.column(0).take(pa.array(row[keep])), b.column(1).take(pa.array(row[keep])), pa.array(np.full(len(keep), m, np.int32)), words.dictionary.take(w).cast(pa.string()),
                              pa.array(times[keep]), pa.array(best[word[keep]]), begins.take(w).cast(pa.string())])
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found, strict=True)], ["k1", "k2", "model", "_word", "n", "best", "word"]) if found else None

    pairs = rows.select("k1", "k2", F.col("model").cast("int").alias("model"), "text").mapInArrow(by_batch(begin), "k1 long, k2 long, model int, _word string, n long, best double, word string")
    ratio = F.element_at("ratios", F.col("model") + 1)
    better = pairs.join(rest.hint("merge"), "word").withColumn("ratio", ratio).filter("ratio > best")
    key = ["k1", "k2", "model"]
    by_word = better.repartition(partitions(rows.sparkSession), *key).groupBy(*key, "_word").agg(F.max("ratio").alias("ratio"), F.max("n").alias("n"), F.max("best").alias("best"))
    grown = F.col("n") * (F.greatest(F.col("ratio") - HIGH, F.lit(0.0)) - F.greatest(F.col("best") - HIGH, F.lit(0.0)))
    return by_word.groupBy(*key).agg(F.max("ratio").alias("top"), F.sum(grown).alias("more"))


def with_rest(part: DataFrame, keyed: DataFrame, models, bits, rest: DataFrame) -> DataFrame:
    """part (k1, k2, model, n_words, x3, x4, ...) with the two expression features as they are with all expressions."""
    out = part.join(joined_part(keyed, models, bits, rest), ["k1", "k2", "model"], "left")
    more = F.coalesce(F.col("more") / F.sqrt("n_words"), F.lit(0.0))
    return out.withColumns({"x3": F.greatest("x3", F.coalesce("top", F.lit(NEVER))), "x4": F.col("x4") + more})


def score_toxicity(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", carry: tuple[str, ...] = (), calibration: int = CALIBRATION) -> DataFrame:
    """One row per row of df: doc_id, held_out, score, predicted (score >= 0.3), and the columns in carry.

    Rows with crc32(id) mod 4 = 2 are held out: their labels are never read. The other remainders are three folds. One model
    of letters per class, and one of expressions (word beginnings, by documents), is trained on all three, and one on each two for calibration on the third (of at most
    `calibration` documents). Both models back off to the same continuation counts, so a rare expression weighs only as far as
    a class has its own evidence. Workers hold the EXPRESSIONS commonest ones; words that begin with another are joined with it. The score is a logistic function of length-normalised log-likelihood ratios: of the whole
    text per letter, and of its most toxic words.

    Null ids are never in training; rows that repeat an id share its label (the largest, if they differ). Texts without a
    word get the score of no evidence; all texts one of 0.01 if there are no labels. Extra columns are ignored.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "toxicity")
    remainder = lambda c: F.crc32(F.col(c).cast("string")) % 4
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(id_col) != 2))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    fold = F.coalesce(*[F.when(remainder("_id") == r, F.lit(i)) for i, r in enumerate(FOLDS)])
    marks = marks.withColumn("cell", (2 * fold + F.least(F.greatest("toxic", F.lit(0)), F.lit(1))).cast("int"))
    texts = df.filter(remainder(id_col) != 2).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # A merge join at any size: labels grow with the documents, and a broadcast that depends on their size would change the plan.
    words = scratch.keep(word_counts(texts.join(marks.hint("merge"), "_id")), "words")
    models, rest = _models(scratch.keep(gram_counts(words), "grams"), scratch.keep(expression_counts(words), "expressions"), words, scratch)
    whole, folded = spark.sparkContext.broadcast({len(FOLDS): models[-1]}), spark.sparkContext.broadcast(dict(enumerate(models[:-1])))  # of bounded size
    del models
    bits = None if rest is None else spark.sparkContext.broadcast((filter_of(rest), filter_of(rest.filter(F.array_max("ratios") > HIGH))))
    hashes = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("k2")]

    xs = [f"x{i}" for i in range(FEATURES)]
    x_kinds = "".join(f", {x} double" for x in xs)

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        model, x = b.column("model").to_numpy(), np.zeros((b.num_rows, FEATURES))
        for m in np.unique(model).tolist():
            x[model == m] = features(b.column("text").filter(pa.array(model == m)), folded.value[m])
        return pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(words_of(b.column("text"))[1]), *map(pa.array, x.T)], [*b.schema.names[1:], "n_words", *xs])

    few = F.broadcast(marks.orderBy(F.xxhash64("_id"), "_id").limit(calibration).select("_id", "cell"))  # bounded
    sample = texts.join(few, "_id").select("text", F.floor(F.col("cell") / 2).cast("int").alias("model"), (F.col("cell") % 2).cast("int").alias("toxic"), *hashes)
    measured = sample.mapInArrow(by_batch(measure), f"model int, toxic int, k1 long, k2 long, n_words long{x_kinds}")
    if rest is not None:
        measured = with_rest(measured, sample, folded, bits, rest)
    measured = measured.select("toxic", *xs).toPandas()
    folded.unpersist()
    weights = logistic(measured.iloc[:, 1:].to_numpy(), measured["toxic"].to_numpy(dtype=float)) if len(measured) else np.array([NO_LABELS, *np.zeros(FEATURES)])
    chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        x = features(b.column(1), whole.value[len(FOLDS)])
        given_ = b.columns[1 if "text" in carry else 2 : 1 + len(names) + ("text" not in carry)]
        if all_held:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(chance(x @ weights[1:] + weights[0])), *given_], ["doc_id", "score", *names])
        z = x[:, :3] @ weights[1:4] + weights[0]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(z), *given_, *b.columns[-3:], pa.array(words_of(b.column(1))[1]), pa.array(x[:, 3]), pa.array(x[:, 4])], ["doc_id", "score", *names, *keys, "n_words", "x3", "x4"])

    names = (["text"] if "text" in carry else []) + [c for c in carry if c != "text"]
    keys, all_held = ["k1", "k2", "model"], rest is None
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    given = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c for c in names if c != "text"])
    made = f"doc_id {kinds[id_col]}, score double" + "".join(f", `{c}` {kinds[text_col if c == 'text' else c]}" for c in names)
    if rest is None:
        out = given.mapInArrow(by_batch(score), made)
    else:
        keyed = given.select("*", *hashes, F.lit(len(FOLDS)).alias("model"))
        part = keyed.mapInArrow(by_batch(score), made + ", k1 long, k2 long, model int, n_words long, x3 double, x4 double")
        z = F.col("score") + F.col("x3") * float(weights[4]) + F.col("x4") * float(weights[5])
        out = with_rest(part, keyed, whole, bits, rest).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
    return out.select("doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *names)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
