"""Packing pieces of documents into sequences: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch, load, portions, release
from siltstone.llm.tokens import encode_ended, encoder, word_bpe_path

#: Partners tried for each length when patterns of three are listed, and passes of the least-squares fit.
PARTNERS, SWEEPS = 24, 40


def patterns(lengths: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths, longest first, that fill a sequence exactly; for a length that is in none, its fullest
    pair, if that leaves room for no other length."""
    have, lengths = set(lengths.tolist()), np.sort(lengths)[::-1]
    found = {(capacity,)} & {(n,) for n in have}
    for a in lengths.tolist():
        rest = capacity - a
        if 0 < rest <= a and rest in have:
            found.add((a, rest))
        second = lengths[(lengths <= a) & (lengths < rest) & (2 * lengths >= rest)]
        for b in second[np.linspace(0, len(second) - 1, min(PARTNERS, len(second))).astype(int)].tolist() if len(second) else []:
            if rest - b in have:
                found.add((a, b, rest - b))
    for a in sorted(have - {n for p in found for n in p}):
        if len(second := lengths[(lengths <= a) & (lengths <= capacity - a)]) and capacity - a - second[0] < lengths[-1]:
            found.add((a, int(second[0])))
    return sorted(found, reverse=True)


def fit(counts: dict[int, int], options: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that come nearest to the histogram in least squares, by coordinate descent."""
    left, x = {n: float(c) for n, c in counts.items()}, np.zeros(len(options))
    parts = [tuple((n, p.count(n)) for n in dict.fromkeys(p)) for p in options]
    square = [sum(m * m for _, m in p) for p in parts]
    for _ in range(SWEEPS):
        most = 0.0
        for j, p in enumerate(parts):
            step = max(-x[j], sum(m * left[n] for n, m in p) / square[j])
            if step:
                x[j] += step
                most = max(most, abs(step))
                for n, m in p:
                    left[n] -= m * step
        if most < 0.25:
            break
    return x


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first sequence, sequences, pieces per sequence, offset) for the pieces counted by length, and the number
    of sequences. Works on the histogram alone, so that its cost doesn't depend on the number of documents."""
    left = {n: c for n, c in counts.items() if c}
    options = patterns(np.array(list(left), np.int64), capacity) if left else []
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for p, x in sorted(zip(options, fit(left, options) if left else [], strict=True), key=lambda o: (capacity - sum(o[0]), len(o[0]), o[0][::-1])):
        n = min([int(x), *(left[k] // p.count(k) for k in p)])
        if n:
            bins.append((tuple((k, p.count(k)) for k in dict.fromkeys(p)), n))
            for k in p:
                left[k] -= n
    # What rounding leaves: best fit, longest first, for all sequences of equal content at once.
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    sizes = np.zeros(capacity + 1, bool)
    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            at = n + int(np.argmax(sizes[n:]))
            if not sizes[at]:
                many = capacity // n
                for per, number in ((many, c // many), (c % many, 1)):
                    if per and number:
                        room.setdefault(capacity - per * n, []).append((((n, per),), number))
                        sizes[capacity - per * n] = True
                break
            content, number = room[at].pop()
            take = min(c, number)
            if take < number:
                room[at].append((content, number - take))
            sizes[at] = bool(room[at])
            grown = (*content[:-1], (n, content[-1][1] + 1)) if content[-1][0] == n else (*content, (n, 1))
            room.setdefault(at - n, []).append((grown, take))
            sizes[at - n] = True
            c -= take
    bins += [x for some in room.values() for x in some]
    slots, first = [], 0
    for content, number in bins:
        offset = 0
        for n, per in content:
            slots.append((n, first, number, per, offset))
            offset += n * per
        first += number
    return slots, first


def cut_pieces(df: DataFrame, *, id_col: str, text_col: str, end_id: int, capacity: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, place): place counts the pieces of equal length in a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in (x for b in batches for x in portions(b)):
            ids, n = encode_ended(tokenizer, b.column(1), end_id)
            k = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            at, raw = (np.cumsum(n) - n)[row] + start, ids.astype("<u4")
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sorted_, place = length[order], np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(place)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])
        encoder(tokenizer).forget()
        release()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long")


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are encoded, end_id behind each, and cut only if longer than capacity. Pieces are numbered within their length:
    in their task first, then by sums over tasks, so that no length's pieces meet anywhere. The histogram (at most `capacity`
    rows) goes to the driver, where patterns are fitted and slots numbered; each piece finds its slot by its number.
    Null or empty texts are one piece of the end id. Rows that repeat an id are packed as documents of their own; null ids
    are kept. An empty table gives no row. Extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "pack")
    pieces = scratch.keep(cut_pieces(df, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity, tokenizer=tokenizer or word_bpe_path()), "pieces")
    held = scratch.keep(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "held")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(counts, capacity)
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    number = table[:, 2] * table[:, 3]
    begin = np.cumsum(number) - number
    begin -= begin[np.searchsorted(table[:, 0], table[:, 0])]
    key = (table[:, 0] << 48) + begin

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            slot = np.searchsorted(key, (length << 48) + rank, "right") - 1
            turn = rank - begin[slot]
            sequence, offset = table[slot, 1] + turn // table[slot, 3], table[slot, 4] + turn % table[slot, 3] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    kind = df.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pack_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
