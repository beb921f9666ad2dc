"""Approximate nearest neighbours by several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch, by_batch, limit_per, load, partitions

#: Numbers of orderings that are tried; coordinates and bits a coordinate of a key; rows of a block; visits of a block in one group.
CURVES, COORDINATES, COORDINATE_BITS, BLOCK, VISITS = (4, 8, 16), 8, 7, 1024, 4096
#: Vectors that scale and centre of the projections, and the width of windows, are fitted on: those of least hash. Queries among them,
#: and the share of their nearest that windows are to find there.
SAMPLE, ASKED, RECALL = 4096, 256, 0.95


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) of `bits` bits a coordinate, by Skilling's transposed form."""
    x, one = cells.T.astype(np.uint64).copy(), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(len(x)):
            hit, swap = (x[i] & q) > 0, (x[0] ^ x[i]) & low
            first = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(hit | (i == 0), x[i], x[i] ^ swap)
            x[0] = first
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> np.uint64(b)) & one > 0, flip ^ ((one << np.uint64(b)) - one), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key.astype(np.int64)


def projection(dims: int, curve: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions and the shift of a curve."""
    rng = np.random.default_rng([seed, dims, curve])
    k = min(COORDINATES, dims)
    return np.linalg.qr(rng.normal(size=(dims, k)))[0], rng.random(k)


def keys(x: np.ndarray, fit: tuple[np.ndarray, float], curve: int, seed: int) -> np.ndarray:
    """Places of vectors (rows) on a curve. Three deviations to either side fill half the grid, by which the curve is shifted."""
    axes, shift = projection(x.shape[1], curve, seed)
    u = ((x - fit[0]) @ axes / fit[1] + 3) / 12 + shift / 2
    return hilbert_keys(np.clip(u * (1 << COORDINATE_BITS), 0, (1 << COORDINATE_BITS) - 1).astype(np.int64), COORDINATE_BITS)


def windows(x: np.ndarray, fit: tuple[np.ndarray, float], k: int, seed: int) -> tuple[int, float]:
    """(orderings, share of the rows in a query's window of each) that find RECALL of the k nearest in a sample, with the least work.

    The same share of more rows finds more, as the nearest of more rows are nearer.
    """
    n = len(x)
    if n < 2:
        return CURVES[0], 1.0
    asked = np.unique(np.linspace(0, n - 1, min(n, ASKED)).astype(int))
    far = (x[asked] ** 2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * x[asked] @ x.T
    far[np.arange(len(asked)), asked] = np.inf
    near = np.argsort(far, axis=1)[:, : min(k, n - 1)]
    away, found = np.full(near.shape, n), []
    for curve in range(CURVES[-1]):
        place = np.empty(n, np.int64)
        place[np.lexsort((np.arange(n), keys(x, fit, curve, seed)))] = np.arange(n)
        away = np.minimum(away, np.abs(place[near] - place[asked][:, None]))
        if curve + 1 in CURVES:
            share = min(1.0, 2 * float(np.quantile(away, RECALL)) / n)
            found.append(((curve + 1) * share, curve + 1, share))
    return min(found)[1:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> blocks of at most BLOCK rows of one ordering (query null), and for each query the block that it lies in."""
    part, no = TaskContext.get().partitionId(), {}
    names = ["curve", "dims", "part", "no", "ids", "counts", "vectors", "query"]

    def block(curve: int, dims: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        node, ids, raw, asks = t.column("node").to_numpy(), t.column("ids").to_pylist(), t.column("vector").to_pylist(), t.column("asks").to_numpy(zero_copy_only=False)
        n = no[curve, dims] = no.get((curve, dims), -1) + 1
        counts = np.array([len(x) // 8 for x in ids], np.int32)
        rows = [(b"".join(ids), counts.tobytes(), b"".join(raw), None), *((None, None, raw[i], int(node[i])) for i in np.flatnonzero(asks))]
        fixed = [pa.array(np.full(len(rows), v, np.int32)) for v in (curve, dims, part, n)]
        yield pa.RecordBatch.from_arrays([*fixed, *(pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.int64())))], names)

    held, n, now = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        curve, dims = b.column("curve").to_numpy(), b.column("dims").to_numpy()
        cuts = [0, *(np.flatnonzero((curve[1:] != curve[:-1]) | (dims[1:] != dims[:-1])) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and now != (curve[lo], dims[lo]):
                yield from block(*map(int, now), held)
                held, n = [], 0
            now = (curve[lo], dims[lo])
            while lo < hi:
                take = min(hi - lo, BLOCK - n)
                held.append(b.slice(lo, take))
                n, lo = n + take, lo + take
                if n == BLOCK:
                    yield from block(*map(int, now), held)
                    held, n = [], 0
    if held:
        yield from block(*map(int, now), held)


def first(n: int, row: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first n of each row by `order`."""
    at = np.lexsort((*order[::-1], row))
    begin = np.concatenate([[True], row[at][1:] != row[at][:-1]]) if len(at) else np.zeros(0, bool)
    return at[np.arange(len(at)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] < n]


def nearest(ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of points, id, distance) of the n nearest ids, ties to the smaller; ids of a vector lie together, counts many, in order.

    Distances are exact in double precision; all vectors are weighed whose rough distance may round to that of the n-th.
    """
    least = np.cumsum(counts) - counts
    size, own = (vectors**2).sum(axis=1), (points**2).sum(axis=1)
    rough = own[:, None] + size[None] - 2 * points @ vectors.T
    slack = 1e-11 * (own + size.max()) * max(1, vectors.shape[1])
    border = np.partition(rough, min(n, len(size)) - 1, axis=1)[:, min(n, len(size)) - 1] + 2 * slack
    row, at = np.nonzero(rough <= border[:, None])
    far = np.concatenate([np.zeros(0), *(np.sqrt(((vectors[at[a : a + 4096]] - points[row[a : a + 4096]]) ** 2).sum(axis=1)) for a in range(0, len(at), 4096))])
    some = first(n, row, far, ids[least[at]])  # of vectors beyond the n-th, even the first id comes later
    row, at, far = row[some], at[some], far[some]
    many = counts[at]
    pick = np.repeat(least[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    row, far = np.repeat(row, many), np.repeat(far, many)
    some = first(n, row, far, ids[pick])
    return row[some], ids[pick][some], far[some]


def search(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k nearest of all other rows found.

    Equal vectors are one point from the start, with its smallest ids; so copies of any number meet nowhere, and ties among
    them are exact. Each of several orderings projects the points to a few random orthonormal directions, shifts and rounds
    them to a grid, and sorts them by (Hilbert key, point), by range over the cluster; blocks of BLOCK points in a row are
    numbered by sums over ranges. A query visits the blocks of its window around its own place as an equi-join on the block;
    each block gives its nearest by exact distance; a query's blocks of all orderings merge. How many orderings and how wide a
    window, as a share of all points, is fitted on a bounded sample (`windows`): little where vectors lie in clusters or near
    a surface of few dimensions; where they are spread evenly over many, no ordering is selective, and windows hold most points.

    Rows whose id or vector is null, or whose vector is empty, zero or holds null or non-finite components, take no part.
    Vectors are compared with those of as many components. Rows that repeat an id and a vector count once; an id with several
    vectors is a candidate with each, and asks with the least by its bytes. Ties go to the smaller id. Fewer candidates than k: all. An
    empty table gives an empty one. Extra columns are ignored.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "ann")
    single = df.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0)))) & F.exists(v, lambda x: x != 0))

    def raw(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(1)
        values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([values[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], ["vec_id", "vector"])

    rows = scratch.keep(rows.mapInArrow(by_batch(raw), "vec_id long, vector binary").distinct(), "rows")
    asking = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.count(F.lit(1)).alias("n"))
    asking = scratch.keep(asking.withColumnRenamed("vec_id", "query_id"), "asking")
    own = asking.agg(F.max("n")).first()[0] or 1  # rows of a query's own id, that go at last
    most = limit_per(rows, ["vector"], ["vec_id"], k + own).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = most.join(asking.select("vector").distinct().withColumn("asks", F.lit(True)), "vector", "left")
    points = scratch.keep(points.select(F.monotonically_increasing_id().alias("node"), "vector", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "points")

    some: dict[int, list[np.ndarray]] = {}
    for r in points.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toLocalIterator():
        some.setdefault(len(r.vector) // kind().itemsize, []).append(np.frombuffer(r.vector, kind).astype(np.float64))
    fits, wide = {}, {}
    for d, x in some.items():
        x = np.array(x)
        fits[d] = x.mean(axis=0), float(np.std(x - x.mean(axis=0))) or 1.0
        wide[d] = windows(x, fits[d], k, seed)

    def place(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.binary_length(b.column(1)).to_numpy() // kind().itemsize
        ids = pa.array([np.array(x, np.int64).tobytes() for x in b.column(2).to_pylist()], pa.binary())
        for d in np.unique(size).tolist():
            mine = pa.array(np.flatnonzero(size == d))
            vectors = b.column(1).take(mine)
            x = np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(-1, d).astype(np.float64)
            fit = fits.get(d, (np.zeros(d), 1.0))
            for curve in range(wide.get(d, (CURVES[0], 1.0))[0]):
                fixed = [pa.array(np.full(len(x), c, np.int32)) for c in (curve, d)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(keys(x, fit, curve, seed)), b.column(0).take(mine), vectors, ids.take(mine), b.column(3).take(mine)], ["curve", "dims", "key", "node", "vector", "ids", "asks"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from place(b)

    placed = points.mapInArrow(places, "curve int, dims int, key long, node long, vector binary, ids binary, asks boolean")
    order = ["curve", "dims", "key", "node"]
    cut = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    cut = scratch.keep(cut.mapInArrow(_blocks, "curve int, dims int, part int, no int, ids binary, counts binary, vectors binary, query long"), "blocks")
    blocks, asked = cut.filter("ids is not null"), cut.filter("query is not null")
    before = Window.partitionBy("curve", "dims").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("curve", "dims", "part").agg(F.count("ids").alias("n"), F.count("query").alias("q"))
    over = Window.partitionBy("curve", "dims")
    base = base.select(F.col("curve").alias("b_curve"), F.col("dims").alias("b_dims"), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(over).alias("all"), F.sum("q").over(over).alias("asks"))
    same = (F.col("curve") == F.col("b_curve")) & (F.col("dims") == F.col("b_dims")) & (F.col("part") == F.col("b_part"))
    share = F.coalesce(*[F.when(F.col("dims") == d, F.lit(s)) for d, (_, s) in wide.items()], F.lit(1.0))
    at = F.col("base") + F.col("no")
    width = F.least(F.col("all"), F.ceil(F.col("all") * share).cast("long") + 1)  # blocks of a window
    begin = F.greatest(F.lit(0), F.least(at - F.floor(width / 2), F.col("all") - width))
    slices = F.greatest(F.lit(1), F.ceil(F.col("asks") * width / F.col("all") / VISITS)).cast("int")  # a block's visits in groups of bounded size
    visits = asked.join(base, same).select(F.col("curve").alias("in_curve"), F.col("dims").alias("in_dims"), "query", F.col("vectors").alias("point"), F.pmod(F.xxhash64("query"), slices).cast("int").alias("in_slice"),
                                           F.explode(F.sequence(begin, begin + width - 1)).alias("in_at"))
    blocks = blocks.join(base, same).select(F.col("curve").alias("curve"), F.col("dims").alias("dims"), at.alias("at"), "ids", "counts", "vectors", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    n = k + own

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        d = left.column("dims")[0].as_py()
        ids, counts = np.frombuffer(left.column("ids")[0].as_py(), np.int64), np.frombuffer(left.column("counts")[0].as_py(), np.int32)
        vectors = np.frombuffer(left.column("vectors")[0].as_py(), kind).reshape(-1, d).astype(np.float64)
        queries, out = right.column("query").to_numpy(), []
        for a in range(0, len(queries), 256):
            points = np.frombuffer(b"".join(right.column("point").slice(a, 256).to_pylist()), kind).reshape(-1, d).astype(np.float64)
            row, found, far = nearest(ids, counts, vectors, points, n)
            out.append((queries[a + row], found, far))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    found = blocks.groupBy("curve", "dims", "at", "slice").cogroup(visits.groupBy("in_curve", "in_dims", "in_at", "in_slice")).applyInArrow(look, "query long, vec_id long, score double").distinct()
    found = limit_per(found, ["query"], ["score", "vec_id"], n).groupBy("query").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))
    by_query = asking.join(points.filter("asks").select("vector", "node"), "vector").select("query_id", "node")
    each = by_query.join(found, F.col("node") == F.col("query")).select("query_id", F.array_sort(F.filter("found", lambda f: f["vec_id"] != F.col("query_id"))).alias("found"))
    each = each.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("at", "f"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", "f.score")


def op2_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"))
