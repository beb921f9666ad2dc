"""Exact top-k search on a bit-sliced index: slices of quantised components are added with bitmap arithmetic."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch, load, partitions
from siltstone.llm.vectors import matrix, quantised

#: Rows of a block of the index; queries of a group; most tasks that pairs of the two are dealt to.
BLOCK, GROUP, TASKS = 8192, 256, 4096


def slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, bits, bitmaps) of integers (rows by components): component j of row i is least[j] + sum of 2^b of the bitmaps that hold i,
    b from 0 to bits[j] - 1. Bitmaps lie in order of (j, b), as 64-bit words in which row i is bit i."""
    least = x.min(axis=0)
    above = x.astype(np.uint64) - least.astype(np.uint64)
    bits = np.array([int(v).bit_length() for v in above.max(axis=0)], np.int64)
    words = -(-len(x) // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for j, n in enumerate(bits.tolist()):
        for b in range(n):
            packed = np.packbits((above[:, j] >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return least, bits, out.view("<u8")


def add(query: np.ndarray, least: np.ndarray, bits: np.ndarray, both: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """(constant, sum slices) of the inner products of a query with all rows of a block; `both` is its bitmaps, then their complements.

    A negative component takes the complement of a slice, counted from the component's greatest value, so that only bitmaps of
    positive weight are added: bit k of |q| and slice b weigh 2^(k + b). Bitmaps of a weight go by threes through full adders, all at
    once, to one of that weight and carries of the next.
    """
    size = np.abs(query).astype(np.uint64)
    first, n = np.cumsum(bits) - bits, len(both) // 2
    constant = sum(q * (low if q > 0 else low + (1 << b) - 1) for q, low, b in zip(query.tolist(), least.tolist(), bits.tolist(), strict=True))
    top = int(size.max(initial=0)).bit_length()
    j, k = np.nonzero(size[:, None] >> np.arange(max(top, 1), dtype=np.uint64) & np.uint64(1))
    many = bits[j]
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    j, k = np.repeat(j, many), np.repeat(k, many)
    weight, which = k + b, first[j] + b + np.where(query[j] < 0, n, 0)
    order = np.argsort(weight, kind="stable")
    ends = np.cumsum(np.bincount(weight, minlength=1)) if len(weight) else np.zeros(0, np.int64)
    out: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    w = 0
    while w < len(ends) or carries:
        held = [both[which[order[ends[w - 1] if w else 0 : ends[w]]]]] if w < len(ends) else []
        now = np.concatenate([*held, *carries])
        carries = []
        while len(now) > 2:
            m = len(now) // 3
            x, y, z = now[:m], now[m : 2 * m], now[2 * m : 3 * m]
            odd = x ^ y
            carries.append(x & y | odd & z)
            odd ^= z
            now = np.concatenate([odd, now[3 * m :]]) if 3 * m < len(now) else odd
        if len(now) == 2:
            carries.append((now[:1] & now[1:]))
            now = now[:1] ^ now[1:]
        out.append(now[0] if len(now) else np.zeros(both.shape[1], "<u8"))
        w += 1
    return constant, out


def places(bitmap: np.ndarray) -> np.ndarray:
    """Rows that a bitmap holds, in order."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(sums: list[np.ndarray], among: np.ndarray, n: int) -> np.ndarray:
    """The n rows of `among` with the highest sums, ties to the first: from the most significant slice down, rows that have the bit are in
    if there is room for all, else those without are out; rows that no slice tells apart are equal, and the first of them fill up."""
    sure, open_ = np.zeros_like(among), among.copy()
    have = 0
    for s in reversed(sums):
        ones = open_ & s
        n_ones = int(np.bitwise_count(ones).sum())
        if have + n_ones > n:
            open_ = ones
        else:
            sure |= ones
            have += n_ones
            open_ &= ~s
            if have == n:
                return places(sure)
    return np.sort(np.concatenate([places(sure), places(open_)[: n - have]]))


def wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def build(rows: DataFrame, blocks: int) -> DataFrame:
    """The index, as a table: rows (vec_id, dims, vector) are dealt to `blocks` blocks by a hash of their id; a block has its ids, ascending, the
    least value and the number of slices of each component, and the slices."""

    def block(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("vector", "ascending")])
        least, bits, bitmaps = slices(matrix(t.column("vector"), key[0].as_py()))
        row = (key[0].as_py(), key[1].as_py(), t.column("vec_id").to_numpy().astype("<i8").tobytes(), least.astype("<i8").tobytes(), bits.astype("<i8").tobytes(), bitmaps.tobytes())
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["dims", "block", "ids", "least", "bits", "bitmaps"])

    dealt = rows.select("dims", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "vector")
    return dealt.groupBy("dims", "block").applyInArrow(block, "dims int, block long, ids binary, least binary, bits binary, bitmaps binary")


def _look(k: int):
    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        d, held = key[0].as_py(), left.to_pylist()[0]
        ids, least, bits = (np.frombuffer(held[c], "<i8") for c in ("ids", "least", "bits"))
        words = -(-len(ids) // 64)
        bitmaps = np.frombuffer(held["bitmaps"], "<u8").reshape(-1, words)
        both = np.concatenate([bitmaps, ~bitmaps])
        every = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view("<u8")
        out: list[tuple[int, int, int]] = []
        for own, query in zip(right.column("query_id").to_pylist(), matrix(right.column("vector"), d), strict=True):
            among = every.copy()
            for i in range(*np.searchsorted(ids, [own, own + 1]).tolist()):  # the query's own rows
                among[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
            constant, sums = add(query, least, bits, both)
            some = top(sums, among, k)
            for i in some.tolist():
                bits_of = sum((int(s[i // 64]) >> (i % 64) & 1) << w for w, s in enumerate(sums))
                out.append((own, int(ids[i]), wrapped(constant + bits_of)))
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names)

    return look


def search(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256, every: int = 50, k: int = 5, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other rows of the highest inner product of
    floor(scale * x), ties to the smaller id; exact.

    The index has a bitmap for each bit of each component over the rows of a block (`build`). The scores of a query with all rows of a
    block are the sum of the slices that its bits select, in adders that work on words of bitmaps; the first k come out of the sum
    from its most significant slice down, and their scores out of its slices at their places (`add`, `top`). A block is the size of one
    for any id or vector, however common. Each pair of a block and a group of queries is one cogroup; the first k of each block meet per query.

    Rows whose id or vector is null, or whose vector is empty or holds null or non-finite components, take no part. Vectors meet those of
    as many components. Rows equal in id and quantised vector are one; an id with several is a candidate with each, and asks with the
    least by components' number and bytes. A query's own id is no candidate. Fewer candidates than k: all. Sums are as wide as they need be;
    a score beyond 64 bits is right in its order and wraps in its value. An empty table gives an empty one. Extra columns are ignored.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "bitsliced")
    rows = scratch.keep(quantised(df, id_col, vector_col, scale).drop("label"), "rows")
    blocks = max(1, -(-rows.count() // block))
    index = scratch.keep(build(rows, blocks), "index")
    one = Window.partitionBy("query_id").orderBy("dims", "vector")
    asking = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    asking = scratch.keep(asking, "asking")
    groups = max(1, -(-asking.count() // group))
    asked = asking.select("dims", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group"), "query_id", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    held = index.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    keys, tasks = ["dims", "block", "group"], max(1, min(TASKS, partitions(spark), blocks * groups))
    pairs = held.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys))
    found = pairs.applyInArrow(_look(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"))
