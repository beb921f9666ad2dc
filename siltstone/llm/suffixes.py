"""Removal of repeated byte strings: shard Burrows-Wheeler transforms, merged, of what can repeat at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.bwt import merge
from siltstone.llm.common import Scratch, by_batch, free, load, partitions, portions, whole_runs

#: Bytes of a gram whose least hash in a window marks the window's anchor.
GRAM = 24
#: Windows that anchors are sought for at once.
STEP = 1 << 19
#: Bytes of a shard, and of what is merged at once (a single gram's contexts may take more, but are MEET at most).
SHARD, CHUNK = 1 << 16, 1 << 20
#: Different contexts of a gram that may meet in one task; those of a gram with more are split by what their windows share.
MEET = 4096
#: Rows of a gram that a task holds at once; a gram with more is split like one with many contexts.
HELD = 1 << 20
#: Windows, next to each other, of a part of a split context, and parts that are made at once.
BAND, PARTS = 11, 1 << 17


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets); null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each anchor: (text, first window start in the text, number of windows, anchor minus first start, hash of its gram).

    Each window of `length` bytes in a text belongs to the gram of least hash in it, the leftmost of equals. Windows in a row
    with the same anchor are one context. All depends on a window's bytes alone, so equal windows lie equally in contexts of
    equal gram. Works in steps of STEP windows; a context that a step cuts becomes two, which does no harm.
    """
    n, size = len(data) - length + 1, np.diff(offsets)
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    good = np.zeros(len(data) + 1, np.int8)  # windows that stay in their text
    some = size >= length
    np.add.at(good, offsets[:-1][some], 1)
    np.add.at(good, offsets[1:][some] - length + 1, -1)
    good = np.cumsum(good[:n], dtype=np.int8) > 0
    found = []
    for a in range(0, n, STEP):
        ok = good[a : a + STEP]
        if not ok.any():
            continue
        at, gram = _least_grams(data[a : a + len(ok) + length - 1], length)
        begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])]))
        run = np.diff(np.append(begin, len(at)))
        begin, run = begin[ok[begin]], run[ok[begin]]
        text = np.searchsorted(offsets, begin + a, "right") - 1
        found.append((text, begin + a - offsets[text], run, at[begin] - begin, gram[at[begin]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)


def _least_grams(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the least gram of each window, hash of the gram at each place)."""
    gram = min(GRAM, length)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    h = np.zeros(len(data) - gram + 1, np.uint64)
    for k, odd in zip(range(0, gram, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=False):
        part = np.ndarray(len(h), "<u8", padded, k, (1,))
        if gram - k < 8:
            part = part & np.uint64((1 << 8 * (gram - k)) - 1)
        h = (h ^ (h >> np.uint64(29))) + part * np.uint64(odd)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, done = length - gram + 1, 1
    while done < span:  # least of windows of doubled width
        step = min(done, span - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def _anchor_rows(b: pa.RecordBatch, length: int) -> pa.RecordBatch | None:
    data, offsets = _buffer(b.column(1))
    text, start, run, off, gram = find_anchors(data, offsets, length)
    if not len(text):
        return None
    begin = offsets[text] + start
    return _spots(gram, _hashes(data.tobytes(), begin, begin + run + length - 1, off), b.column(0).to_numpy()[text], start, run, off, length)


def _hashes(raw: bytes, begin: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(raw[x:y], o) for x, y, o in zip(begin.tolist(), end.tolist(), seed.tolist(), strict=True)), np.uint64, len(begin))


def _spots(gram: np.ndarray, context: np.ndarray, key: np.ndarray, start: np.ndarray, run: np.ndarray, off: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of contexts. Of equal ones in a batch all but the first are settled here; they travel by a hash of their place, so
    none of them meet."""
    spot, stop = (start << 24) | (run << 12) | off, np.zeros(len(start), np.int64)
    order = np.lexsort((spot, key, context, gram))
    again = order[1:][(gram[order][1:] == gram[order][:-1]) & (context[order][1:] == context[order][:-1])]
    stop[again] = start[again] + run[again] + length - 1
    spot[again] = start[again]
    gram[again] = (key[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (spot[again].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(key), pa.array(spot), pa.array(stop)], ["gram", "context", "key", "spot", "stop"])


def _parts(batches: Iterator[pa.RecordBatch], length: int, band: int) -> Iterator[pa.RecordBatch]:
    """(key, text, array of (gram, spot)) -> rows of the contexts' parts, as of contexts.

    The windows of a context lie 0, 1, 2 ... bytes before its anchor; `band` of these places make a part. All windows that a
    part can have hold the same length - band + 1 bytes, its core, and a hash of it takes the place of the gram. Equal windows lie equally
    before equal grams, so they are in parts of equal core. With a band of 1 the core is the window itself.
    """
    for b in (part for whole in batches for part in portions(whole)):
        data, offsets = _buffer(b.column(1))
        raw, looks = data.tobytes(), b.column(2)
        flat, n = looks.flatten(), np.diff(looks.offsets.to_numpy())
        row, spot, gram = np.repeat(np.arange(b.num_rows), n), flat.field("spot").to_numpy(), flat.field("gram").to_numpy().view(np.uint64)
        start, run, off = spot >> 24, (spot >> 12) & 0xFFF, spot & 0xFFF
        low = (off - run + 1) // band
        many = off // band - low + 1
        ends, at = np.cumsum(many), 0
        while at < len(spot):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + PARTS, "right")))
            mine = np.repeat(np.arange(at, upto), many[at:upto])
            place = low[mine] + np.arange(len(mine)) - (ends - many)[mine] + ends[at] - many[at]
            first, last = np.maximum(0, off[mine] - (place + 1) * band + 1), np.minimum(run[mine] - 1, off[mine] - place * band)
            base = offsets[row[mine]]
            core = base + start[mine] + off[mine] - place * band
            begin, runs, offs = start[mine] + first, last - first + 1, off[mine] - first
            group = _hashes(raw, core, core + length - band + 1, gram[mine] + place.astype(np.uint64))
            context = _hashes(raw, base + begin, base + begin + runs + length - 1, offs)
            yield _spots(group, context, b.column(0).to_numpy()[row[mine]], begin, runs, offs, length)
            at = upto


def _sorted_out(batches: Iterator[pa.RecordBatch], length: int, meet: int | None, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by gram, context and place: all but the first of equal ones repeat as a whole (stop > 0: start and stop
    of the bytes). The first ones of a gram with several contexts are to be looked into (stop = 0: start is the spot), or split
    (stop = -1) if there are more than `meet`, or if a task can't hold the gram's rows; meet=None: never."""
    names, last = ["key", "gram", "start", "stop"], None
    for t in whole_runs(batches, "gram", min(100_000, held), held):
        gram, context, key, spot, stop = (t.column(c).to_numpy() for c in ("gram", "context", "key", "spot", "stop"))
        if (settled := stop > 0).any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[settled], np.zeros(settled.sum(), np.int64), spot[settled], stop[settled])], names)
            gram, context, key, spot = (x[~settled] for x in (gram, context, key, spot))
            if not len(gram):
                continue
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        first = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
        group = np.cumsum(new_gram) - 1
        cut = np.zeros(group[-1] + 1, bool)  # the run goes on in the next table, or began in the one before
        cut[-1] = t.num_rows >= held
        if last is not None and gram[0] == last[0]:
            cut[0], first[0] = True, context[0] != last[1]
        last = gram[-1], context[-1]
        many = np.bincount(group[first], minlength=group[-1] + 1)
        look, again = first & ((many > 1) | cut)[group], ~first
        split = ((many > meet) | cut)[group[look]] if meet is not None else np.zeros(look.sum(), bool)
        start = np.concatenate([spot[look], spot[again] >> 24])
        stop = np.concatenate([np.where(split, -1, 0), (spot[again] >> 24) + ((spot[again] >> 12) & 0xFFF) + length - 1])
        if len(start):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[look], key[again]])), pa.array(np.concatenate([gram[look], np.zeros(again.sum(), np.int64)])), pa.array(start), pa.array(stop)], names)


def _contexts(b: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """(key, text, array of (gram, spot)) -> the contexts' bytes."""
    data, offsets = _buffer(b.column(1))
    looks = b.column(2)
    flat, n = looks.flatten(), np.diff(looks.offsets.to_numpy())
    row, spot = np.repeat(np.arange(b.num_rows), n), flat.field("spot").to_numpy()
    begin = offsets[row] + (spot >> 24)
    raw = data.tobytes()
    body = [raw[x:y] for x, y in zip(begin.tolist(), (begin + ((spot >> 12) & 0xFFF) + length - 1).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([flat.field("gram"), b.column(0).take(pa.array(row)), pa.array(spot), pa.array(body, pa.binary())], ["gram", "key", "spot", "body"])


def _repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by gram -> (key, start, stop) of windows that an earlier context of the same gram holds as well."""
    for t in whole_runs(batches, "gram", 4096):
        gram, key, spot = (t.column(c).to_numpy() for c in ("gram", "key", "spot"))
        data, offsets = _buffer(t.column("body").combine_chunks())
        begin = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(gram))
        at = 0
        while at < len(begin) - 1:  # as many whole grams as a chunk takes
            upto = max(at + 1, int(np.searchsorted(offsets[begin], offsets[begin[at]] + CHUNK, "right")) - 1)
            rows = slice(begin[at], begin[upto])
            found = repeated_windows(data[offsets[begin[at]] : offsets[begin[upto]]], offsets[begin[at] : begin[upto] + 1] - offsets[begin[at]], key[rows], (spot[rows] >> 24) + (spot[rows] & 0xFFF), (spot[rows] >> 12) & 0xFFF, length)
            at = upto
            if len(found[0]):
                who, window, many = found
                start = (spot[rows] >> 24)[who] + window
                yield pa.RecordBatch.from_arrays([pa.array(key[rows][who]), pa.array(start), pa.array(start + many + length - 1)], ["key", "start", "stop"])


def repeated_windows(data: np.ndarray, offsets: np.ndarray, key: np.ndarray, anchor: np.ndarray, run: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, number of windows) of windows of a context that start earlier in another, by (key, anchor)."""
    shards, low = [], 0
    while low < len(run):  # whole contexts
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SHARD, "right")) - 1)
        shards.append(data[offsets[low] : offsets[high]])
        low = high
    place, block = merge(shards, length)
    context = np.repeat(np.arange(len(run)), np.diff(offsets))
    window = np.arange(len(data)) - offsets[context]
    place, block = place[(window < run[context])[place]], block[(window < run[context])[place]]
    rank = np.empty(len(run), np.int64)
    rank[np.lexsort((anchor, key))] = np.arange(len(run))
    mine = rank[context[place]]
    first = np.full(int(block.max(initial=-1)) + 1, len(run))
    np.minimum.at(first, block, mine)
    repeat = np.zeros(len(data) + 1, bool)
    repeat[place[mine > first[block]]] = True
    edge = np.flatnonzero(repeat[:-1] & ~(np.concatenate([[False], repeat[:-2]]) & np.concatenate([[True], context[1:] == context[:-1]])))
    stop = np.flatnonzero(repeat[:-1] & ~(repeat[1:] & np.append(context[1:] == context[:-1], False)))
    return context[edge], window[edge], stop - edge + 1


def _strip(b: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, text, array of (start, stop)) -> sizes and what is kept."""
    data, offsets = _buffer(b.column(1))
    spans = b.column(2)
    flat, n = spans.flatten(), np.diff(spans.offsets.to_numpy())
    row = np.repeat(np.arange(b.num_rows), n)
    change = np.zeros(len(data) + b.num_rows + 1, np.int32)  # a place for each byte and one behind each text
    base = offsets[:-1] + np.arange(b.num_rows)
    np.add.at(change, base[row] + flat.field("start").to_numpy(), 1)
    np.add.at(change, base[row] + flat.field("stop").to_numpy(), -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = gone & ~np.concatenate([[False], gone[:-1]])
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(base, len(gone))])
    removed = total(gone)
    body = np.ones(len(gone), bool)
    body[base + np.diff(offsets)] = False
    kept = data[~gone[body]]
    size = np.diff(offsets)
    ends = np.concatenate([[0], np.cumsum(size - removed)])
    raw = kept.tobytes()
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(removed), pa.array(total(edge)), pa.array([raw[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())],
                                      ["_key", "n_bytes", "n_removed", "n_spans", "kept"])


def strip_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, carry: tuple[str, ...] = (), meet: int = MEET) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept (binary), and the columns named in carry.

    Of each text's UTF-8 bytes those go that a string of `length` bytes covers which also starts earlier: in a text of smaller
    id, or before in the same text. Rows of equal id stand in order of their text, and of a hash of all their columns; null
    ids come first. Null texts are empty. Strings are judged on the input. An empty table gives an empty one. `length` is 4,095 at most.

    1. Each window of `length` bytes is assigned to an anchor in it, by its bytes alone; windows of one anchor in a row are a
       context (40 windows, about). Contexts equal as a whole are settled first, all but the first go: in a batch, then at their
       gram's partition, where hashes and places are sent. 2. Only first contexts of grams with several of them are fetched from the texts and come
       together by gram; their shards' transforms are merged, which shows the windows they share. 3. Texts meet their spans.

    Of a gram with more than `meet` different contexts these are split, before step 2, into parts of BAND windows that meet by the bytes which
    all windows of a part share, and parts of a core that is still as frequent into single windows; so neither a task's memory
    nor a merge grows with how often a gram stands in the table.
    """
    if not 1 <= length <= 0xFFF:
        raise ValueError("length must be 1 to 4095")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "suffixes")
    integral = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *carry)
    ids = df.select(F.col(id_col).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or i is null")
    plain = integral and ids.isEmpty()
    if plain:
        docs = docs.withColumn("_key", F.col("doc_id").cast("long"))
    else:  # number the rows in order: by range, then by sums over ranges
        order = [F.col("doc_id").asc_nulls_first(), F.col("_text").asc_nulls_first(), F.xxhash64(*[F.col(c) for c in docs.columns])]
        ranged = scratch.keep(docs.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranged")
        held = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        numbered = ranged.withColumn("_key", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")).join(held.select("_part", "_base"), "_part")
        docs = scratch.keep(numbered.withColumn("_key", F.col("_key") + F.col("_base")).drop("_part", "_base"), "docs")

    n, kind = partitions(spark), "gram long, context long, key long, spot long, stop long"

    def sort_out(spots: DataFrame, meet: int | None, name: str) -> DataFrame:
        spots = spots.repartition(n, "gram").sortWithinPartitions("gram", "context", "key", "spot")
        out = scratch.keep(spots.mapInArrow(lambda x: _sorted_out(x, length, meet), "key long, gram long, start long, stop long"), name)
        free(spark)
        return out

    def fetch(sorted_out: DataFrame, stop: int) -> DataFrame:
        looks = sorted_out.filter(F.col("stop") == stop).groupBy("key").agg(F.collect_list(F.struct("gram", F.col("start").alias("spot"))).alias("looks"))
        return docs.select("_key", "_text").join(looks, F.col("_key") == F.col("key")).select("_key", "_text", "looks")

    sorted_out = every = sort_out(docs.select("_key", "_text").mapInArrow(by_batch(lambda b: _anchor_rows(b, length)), kind), meet, "sorted")
    for band, again in ((min(BAND, (length + 3) // 4), meet), (1, None)):
        if sorted_out.filter("stop = -1").isEmpty():
            break
        sorted_out = sort_out(fetch(sorted_out, -1).mapInArrow(lambda x, band=band: _parts(x, length, band), kind), again, f"parts{band}")
        every = every.union(sorted_out)

    met = fetch(every, 0)
    bodies = met.mapInArrow(by_batch(lambda b: _contexts(b, length)), "gram long, key long, spot long, body binary").repartition(n, "gram").sortWithinPartitions("gram")
    shared = scratch.keep(bodies.mapInArrow(lambda x: _repeats(x, length), "key long, start long, stop long"), "shared")
    free(spark)

    spans = every.filter("stop > 0").select("key", "start", "stop").union(shared).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = docs.select("_key", "_text").join(spans, F.col("_key") == F.col("key"), "left").select("_key", "_text", F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))
    out = spans.mapInArrow(by_batch(_strip), "_key long, n_bytes long, n_removed long, n_spans long, kept binary")
    if plain and not carry:
        return out.withColumnRenamed("_key", "doc_id")
    return docs.drop("_text").join(out, "_key").drop("_key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *carry)


def op5_strip_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
