"""Importance resampling towards a target text distribution, on hashed word n-grams found by a byte automaton over Arrow buffers."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch, load, partitions, portions, release

#: Buckets of features, words of the longest feature, share that is drawn in per cent, words that a drawn text has at least, seed.
BUCKETS, ORDER, SHARE, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Bytes of a feature that are worked on for all starts at once; the few longer ones go on one by one. Starts of a step.
STEPS, STARTS = 96, 1 << 19


def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, lower case, CRC step) of each byte. A byte is of a word if it is an ASCII letter or digit, or part of a longer character;
    the step is the reflected CRC-32 of one byte, from its polynomial."""
    byte = np.arange(256)
    letter = (byte | 0x20 >= ord("a")) & (byte | 0x20 <= ord("z")) & (byte < 0x80)
    word = letter | (byte >= 0x80) | (byte >= ord("0")) & (byte <= ord("9"))
    lower = np.where(letter, byte | 0x20, byte).astype(np.uint8)
    step = byte.astype(np.uint32)
    for _ in range(8):
        step = step >> np.uint32(1) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return word, lower, step


WORD_BYTE, LOWER, CRC = automaton()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts in Arrow's own buffers; null counts as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length, text) of each word: a word begins where the class of bytes rises or a text begins, and ends where it falls or a
    text ends, which differences of the classes tell."""
    inside = WORD_BYTE[raw]
    rises = np.empty(len(raw) + 1, bool)
    rises[:-1], rises[-1] = inside, False
    rises[1:-1] &= ~inside[:-1]
    falls = np.empty(len(raw) + 1, bool)
    falls[0], falls[1:] = False, inside
    falls[1:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(raw))]
    cut = cut[inside[cut] & inside[cut - 1]]  # a word would run on into the next text
    rises[cut], falls[cut] = True, True
    begin, end = np.flatnonzero(rises), np.flatnonzero(falls)
    return begin, end - begin, np.searchsorted(ends, begin, "right") - 1


def features(raw: np.ndarray, ends: np.ndarray, order: int = ORDER, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, texts, buckets) of all runs of 1 to `order` words in a row, portion by portion.

    The CRC of a run goes on from that of the run without its last word, over a space and the word's bytes; all starts take a byte at once, those of
    the longest word first, so that the ones still going are a prefix.
    """
    begin, length, text = words(raw, ends)
    small = LOWER[raw]
    for lo in range(0, len(begin), STARTS):
        here = np.arange(lo, min(lo + STARTS, len(begin)))
        state = np.full(len(here), 0xFFFFFFFF, np.uint32)
        for n in range(order):
            last = here + n
            keep = last < len(begin)
            keep[keep] &= text[last[keep]] == text[here[keep]]
            here, state, last = here[keep], state[keep], last[keep]
            if n:
                state = CRC[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ state >> np.uint32(8)
            size = np.minimum(length[last], STEPS + 1)
            turn = np.argsort(size.astype(np.int16), kind="stable")[::-1]
            at, size, now = begin[last][turn], size[turn], state[turn]
            longest = int(size[0]) if len(size) else 0
            for t, m in enumerate(np.searchsorted(-size, -np.arange(min(STEPS, longest)), "left")):
                now[:m] = CRC[(now[:m] ^ small[at[:m] + t]) & np.uint32(0xFF)] ^ now[:m] >> np.uint32(8)
            for i in np.flatnonzero(size > STEPS):
                rest = small[at[i] + STEPS : at[i] + length[last[turn[i]]]]
                now[i] = zlib.crc32(rest.data, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            state = np.empty_like(now)
            state[turn] = now
            yield n + 1, text[here], (~state % np.uint32(buckets)).astype(np.int64)


def counted(texts: DataFrame, buckets: int, order: int) -> DataFrame:
    """(bucket, n) of all features of a table of one column of texts; a task sums up what it reads before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for part in portions(b):
                for _, _, bucket in features(*buffers(part.column(0)), order, buckets):
                    n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])
        release()

    return texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(have: dict[int, int], want: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 * ln(share of the target / share of the corpus)) of each bucket, with one added to each count."""
    s, t = float(sum(have.values()) + buckets), float(sum(want.values()) + buckets)
    return np.array([math.floor(1000 * math.log((want.get(b, 0) + 1) * s / ((have.get(b, 0) + 1) * t))) for b in range(buckets)], np.int64)


def weighed(gain: np.ndarray, order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) -> (id, words, features, weight)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b):
                raw, ends = buffers(part.column(1))
                n, n_words, weight = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for run, text, bucket in features(raw, ends, order, len(gain)):
                    mine = np.bincount(text, minlength=len(n))
                    n += mine
                    if run == 1:
                        n_words += mine
                    g = gain[bucket]
                    edge = np.flatnonzero(np.diff(text, prepend=-1))
                    if len(edge):
                        np.add.at(weight, text[edge], np.add.reduceat(g, edge))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
        release()

    return weigh


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS,
             order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document. Those of the `share` per cent (of the documents with least_words words or more)
    with the highest scores are drawn, without replacement: rank is 1, 2, 3... from the highest score down, ties to the smaller id; null if not drawn.

    A feature is a run of 1 to `order` words, its bucket the CRC-32 of its bytes modulo `buckets`; a document's weight is the sum of the gains
    of its features, a gain the rounded-down log ratio of a bucket's shares in target and corpus; its score adds Gumbel noise from a
    hash of seed and id, so that the highest scores are a sample by weight. Counts of buckets are summed in tasks, then by
    bucket: their number is a parameter and all that reaches the driver. Texts are read twice; four numbers a document are kept. Places in
    the ranking are sums over the parts of a sort by range.

    Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased, over whole texts; a null text has none, as an empty one. Rows that repeat an id
    are documents of their own and share the noise; a null id counts as empty in it and comes last among equals. Without target texts all
    gains follow from the corpus alone; an empty table gives an empty one. Extra columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "resample")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    have = {r.bucket: r.n for r in counted(docs.select("text"), buckets, order).collect()}  # at most `buckets` rows
    want = {r.bucket: r.n for r in counted(target.select(F.col(target_col).cast("string")), buckets, order).collect()}
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(weighed(gains(have, want, buckets), order), f"doc_id {kind}, n_words long, n_features long, weight long")
    rows = scratch.keep(rows, "weighed")  # a sort by range reads its input twice
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("_able", F.col("n_words") >= least_words)

    turn = [F.desc("_able"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = rows.repartitionByRange(partitions(spark), *turn).sortWithinPartitions(*turn)
    ranked = scratch.keep(ranked.withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part, no = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_able").alias("able"))  # one row a part
    base = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    drawn = share * (sizes.agg(F.sum("able")).first()[0] or 0) // 100
    place = F.col("_base") + no + 1
    out = ranked.withColumn("_part", part).join(F.broadcast(base), "_part")
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_able") & (place <= drawn), place).alias("rank"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
