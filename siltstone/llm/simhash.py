"""SimHash near-duplicates by anchor-point covering with a product of perfect codes."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import Scratch, by_batch, load, partitions, text_bytes, whole_runs
from siltstone.llm.components import components

#: Perfect codes whose product covers 64 bits: (bits, generator polynomial, covering radius) of two Golay codes, a Hamming code
#: and a threefold repetition. Each value of a block lies within its radius of exactly one code word; 2 ** 36 anchors in all.
CODES = [(23, 0b101011100011, 3), (23, 0b101011100011, 3), (15, 0b10011, 1), (3, 0b111, 1)]
#: Runs of fingerprints at one anchor of at most so many rows are compared pair by pair; longer ones from one link to the next.
PAIRWISE = 8


def few_bits(bits: int, most: int) -> np.ndarray:
    """All values of `bits` bits of which `most` are set at most, in ascending order."""
    return np.array(sorted(sum(1 << i for i in some) for k in range(most + 1) for some in itertools.combinations(range(bits), k)), np.int64)


@functools.cache
def halves(bits: int, poly: int) -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the values of a block's low 12 bits, and of those above; a whole table of 23 bits would take 32 MB a worker."""
    out = []
    for low, high in ((0, min(bits, 12)), (12, max(bits, 12))):
        rest, degree = np.arange(1 << (high - low), dtype=np.int64) << low, poly.bit_length() - 1
        for bit in range(bits - 1, degree - 1, -1):
            rest ^= ((rest >> bit) & 1) * (poly << (bit - degree))
        out.append(rest.astype(np.int32))
    return tuple(out)


def remainders(values: np.ndarray, bits: int, poly: int) -> np.ndarray:
    """Of values of a block, modulo the code's generator; the code is linear, so halves add up."""
    low, high = halves(bits, poly)
    return low[values & 0xFFF] ^ high[values >> 12]


@functools.cache
def leaders(bits: int, poly: int, radius: int) -> np.ndarray:
    """The one error within the radius that has a given remainder."""
    near = few_bits(bits, radius)
    out = np.zeros(1 << (poly.bit_length() - 1), np.int64)
    out[remainders(near, bits, poly)] = near
    return out


@functools.cache
def offsets(code: tuple[int, int, int], extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each remainder: the differences between a value and every code word within radius + extra of it.

    A code word lies so near exactly if it is the nearest one of a value at most `extra` bits away. Returned as
    (differences, how many extra bits each needs), ordered by remainder and need, with the places at which each remainder's
    needs begin (a row per remainder; the last column is its end).
    """
    bits, poly, _ = code
    leader, flips = leaders(*code), few_bits(bits, extra)
    need = np.bitwise_count(flips.astype(np.uint32)).astype(np.int64)
    r = np.arange(len(leader))[:, None]
    found = flips[None, :] ^ leader[r ^ remainders(flips, bits, poly)[None, :]]
    key = np.unique(((np.broadcast_to(r, found.shape) << 32) | (found << 4) | need[None, :]).ravel())
    key = key[np.concatenate([[True], (key[1:] >> 4) != (key[:-1] >> 4)])]
    remainder, differ, need = key >> 32, (key >> 4) & ((1 << 28) - 1), key & 15
    order = np.lexsort((differ, need, remainder))
    begins = np.searchsorted((remainder * 16 + need)[order], np.arange(len(leader))[:, None] * 16 + np.arange(extra + 2)[None, :])
    return differ[order].astype(np.uint64), need[order], begins


def blocks(prints: np.ndarray) -> list[tuple[tuple[int, int, int], np.uint64, np.ndarray]]:
    """(code, place, the fingerprints' remainders) of each block."""
    out, at = [], 0
    for code in CODES:
        part = (prints >> np.uint64(at)) & np.uint64((1 << code[0]) - 1)
        out.append((code, np.uint64(at), remainders(part.astype(np.int64), *code[:2])))
        at += code[0]
    return out


def anchors(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint): every anchor within covering radius plus threshold.

    An anchor is a code word of each block. Blocks share the threshold: block b may lie its radius and i(b) bits off, where
    the i(b) sum up to the threshold at most. A fingerprint's home is the anchor within all radii; one at most `threshold`
    bits away is sent there, so the two meet at either's home. With half the threshold (rounded up) they still meet, at the
    home of a value half-way between them, but then neither needs to be at home.
    """
    row, left, anchor = np.arange(len(prints)), np.full(len(prints), threshold), prints.copy()
    for code, at, remainder in blocks(prints):
        differ, need, begins = offsets(code, threshold)
        begin, end = begins[remainder[row], 0], begins[remainder[row], left + 1]
        lengths = end - begin
        more = np.repeat(np.arange(len(row)), lengths)
        pick = np.arange(len(more)) - (np.cumsum(lengths) - lengths)[more] + begin[more]
        row, left, anchor = row[more], left[more] - need[pick], anchor[more] ^ (differ[pick] << at)
    return anchor.view(np.int64), row


def homes(prints: np.ndarray) -> np.ndarray:
    out = prints.copy()
    for code, at, remainder in blocks(prints):
        out ^= leaders(*code)[remainder].astype(np.uint64) << at
    return out.view(np.int64)


def fingerprint(text: bytes, words: int = 3, distinct: bool = False) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; see simhash_prints."""
    parts = text.lower().split()  # bytes: ASCII only
    if not parts:
        return 0
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    elif words == 1:
        shingles = parts
    else:
        joined, ends = b" ".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        shingles = [joined[a:b] for a, b in zip(begins[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    hashes = np.fromiter([h(x, 42) for x in (set(shingles) if distinct else shingles)], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def simhash_prints(df: DataFrame, id_col: str, text_col: str, words: int = 3, distinct: bool = False, confirm: int | None = None) -> DataFrame:
    """(doc_id, fp long, check long) of whole texts: A-Z lowered, words split at ASCII white space, shingles of `words` words with
    repeats, or each once if distinct (fewer words: the whole sequence; none, or null: zero), XXH64 with seed 42; a bit is set if over
    half the hashes have it. check is the same of shingles of `confirm` words, 0 without."""
    kind = df.schema[id_col].dataType

    def prints(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(b.column(1))
        fp = np.fromiter((fingerprint(x, words, distinct) for x in texts), np.uint64, b.num_rows)
        check = np.fromiter((fingerprint(x, confirm) for x in texts), np.uint64, b.num_rows) if confirm else np.zeros(b.num_rows, np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), pa.array(check.view(np.int64))], ["doc_id", "fp", "check"])

    fields = [T.StructField("doc_id", kind), T.StructField("fp", T.LongType()), T.StructField("check", T.LongType())]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(by_batch(prints), T.StructType(fields))


def forest(fp: np.ndarray, check: np.ndarray, threshold: int, most: int) -> np.ndarray:
    """Links (2, n) that join what belongs together among fingerprints, one less than each component has.

    Each component is walked from link to link; what is reached leaves the rest, so that a close group of n costs about n
    comparisons, and only what links to nothing is compared with all.
    """
    rest, found = np.arange(len(fp)), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            some = max(1, min(64, (1 << 21) // len(rest)))
            few, front = front[:some], front[some:]
            near = np.bitwise_count(fp[few, None] ^ fp[None, rest]) <= threshold
            if most < 64:
                near &= np.bitwise_count(check[few, None] ^ check[None, rest]) <= most
            hit = near.any(axis=0)
            found.append(np.stack([rest[hit], few[near[:, hit].argmax(axis=0)]]))
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, by links (a, b)."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def links(batches: Iterator[pa.RecordBatch], threshold: int, reach: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints that meet at an anchor, only as many as join what belongs together: of all that meet in some
    100,000 rows, each to the least of its component."""
    for t in whole_runs(batches, "anchor"):
        at, fp, check = (t.column(c).to_numpy() for c in ("anchor", "fp", "check"))
        fp, check = fp.view(np.uint64), check.view(np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        length = np.diff(np.concatenate([begin, [len(at)]]))
        run = np.repeat(np.arange(len(length)), length)
        ok = length > 1
        if reach >= threshold:  # what is linked meets at the home of one of the two as well
            at_home = np.zeros(len(length), bool)
            at_home[run[homes(fp) == at]] = True
            ok &= at_home
        if not ok.any():
            continue
        few = np.flatnonzero((ok & (length <= PAIRWISE))[run])
        found = []
        for k in range(1, min(PAIRWISE, int(length.max()))):
            a, b = few[k:], few[:-k]
            near = (run[a] == run[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= threshold)
            if most < 64:
                near &= np.bitwise_count(check[a] ^ check[b]) <= most
            found.append(np.stack([a[near], b[near]]))
        for k in np.flatnonzero(ok & (length > PAIRWISE)).tolist():
            mine = slice(begin[k], begin[k] + length[k])
            found.append(forest(fp[mine], check[mine], threshold, most) + begin[k])
        rows, ends = np.unique(np.concatenate(found, axis=1), return_inverse=True)
        if not len(rows):
            continue
        nodes, number = np.unique(np.stack([fp[rows], check[rows]], axis=1), axis=0, return_inverse=True)
        ends = number.ravel()[ends.reshape(2, -1)]
        root = stars(ends[0], ends[1], len(nodes))
        a, b = nodes[root != np.arange(len(nodes))].view(np.int64), nodes[root[root != np.arange(len(nodes))]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (a[:, 0], a[:, 1], b[:, 0], b[:, 1])], ["a_fp", "a_check", "b_fp", "b_check"])


def simhash_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distinct: bool = False, threshold: int = 2, reach: int | None = None,
                       confirm: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, fp long, component_id): component_id is the smallest doc_id that a chain of links reaches, the row's own included.

    Fingerprints link at `threshold` or fewer differing bits. Equal fingerprints are one node from the start (combined
    before any shuffle), so groups of copies of any size cost one row; nodes meet at anchors, about 165 each at threshold 2.
    Anchors within covering radius plus `reach` are used: the threshold, or less down to half of it, which takes fewer copies.
    At an anchor a group sends one link less than it has members, not its pairs.

    confirm=(n, bits): a link also takes that second fingerprints, of shingles of n words, differ in `bits` bits at most; a node is
    then a pair of fingerprints. They differ in 64 * acos(c) / pi bits, about, at a cosine of c.

    Null or empty texts have fingerprint zero and link like any other. Rows with equal id are separate rows with the same
    id; rows with null id keep their component's smallest id. Extra columns are ignored; an empty table gives an empty one.
    """
    spark, scratch, reach = df.sparkSession, Scratch(df.sparkSession, "simhash"), threshold if reach is None else reach
    if 2 * reach < threshold:
        raise ValueError("reach must be half the threshold at least")
    shingle, most = confirm or (None, 64)
    docs = scratch.keep(simhash_prints(df, id_col, text_col, words, distinct, shingle), "docs")
    nodes = docs.groupBy("fp", "check").agg(F.min("doc_id").alias("least"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id() if confirm else F.col("fp")), "nodes")  # written once, so numbers stay

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, check = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for k in range(0, len(every), 1024):
                anchor, row = anchors(every[k : k + 1024], reach)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(every[k + row].view(np.int64)), pa.array(check[k + row])], ["anchor", "fp", "check"])

    met = nodes.select("fp", "check").mapInArrow(replicate, "anchor long, fp long, check long").repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    pairs = met.mapInArrow(lambda batches: links(batches, threshold, reach, most), "a_fp long, a_check long, b_fp long, b_check long")
    if confirm:
        number = lambda side: nodes.select(F.col("fp").alias(f"{side}_fp"), F.col("check").alias(f"{side}_check"), F.col("node").alias(side))
        pairs = pairs.join(number("a"), ["a_fp", "a_check"]).join(number("b"), ["b_fp", "b_check"]).select("a", "b")
    else:
        pairs = pairs.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    roots = components(pairs, scratch)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(named.join(least, "root").select("fp", "check", "component_id"), "named")
    return docs.join(named, ["fp", "check"]).select("doc_id", "fp", "component_id")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
