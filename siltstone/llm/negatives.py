"""Hard negatives by a two-dimensional block matrix multiply of anchors with all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import Scratch, limit_per, load, partitions
from siltstone.llm.vectors import highest, matrix, narrow, quantised

#: Rows of a block; components of a chunk; anchors of a tile; most tasks that tiles are dealt to.
BLOCK, CHUNK, ANCHORS, TASKS = 4096, 32, 64, 4096

_BLOCKS = "dims int, at long, low long, high long, chunk int, kind string, part binary, ids binary, labels binary, groups array<struct<no int, ids binary, labels binary, part binary>>"
_TILE = ["dims", "a", "no", "i"]


def blocks(rows: DataFrame, scratch: Scratch, size: int, chunk: int, anchors: int) -> DataFrame:
    """Rows in order of (dims, label, id), cut into blocks of `size` of them, numbered from 0 in each dims; a block has one row for each
    chunk of components, with the anchors of the block in groups of bounded size.

    Places in the order are sums over the parts of a sort by range: one row a part is all that is summed.
    """
    order = ["dims", "label", "vec_id", "vector", "asks"]
    spark = rows.sparkSession
    rows = scratch.keep(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    part, no = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    base = rows.groupBy("dims", part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min(no).alias("_first"))
    before = Window.partitionBy("dims").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(F.col("dims").alias("_dims"), "_part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    placed = rows.withColumn("_p", part).join(base, (F.col("dims") == F.col("_dims")) & (F.col("_p") == F.col("_part")))
    placed = placed.select("dims", F.floor((F.col("_base") + no) / size).cast("long").alias("at"), "label", "vec_id", "vector", "asks")

    def cut(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("vector", "ascending"), ("asks", "ascending")])
        d = key[0].as_py()
        x, ids, labels = matrix(t.column("vector"), d), t.column("vec_id").to_numpy().astype("<i8"), t.column("label").to_numpy().astype("<i8")
        asks = np.flatnonzero(t.column("asks").to_numpy())
        out = []
        for k, lo in enumerate(range(0, d, chunk)):
            kind, raw = narrow(x[:, lo : lo + chunk])
            groups = [{"no": g, "ids": ids[some].tobytes(), "labels": labels[some].tobytes(), "part": x[some, lo : lo + chunk].astype(kind).tobytes()}
                      for g, some in enumerate(asks[a : a + anchors] for a in range(0, len(asks), anchors))]
            out.append((d, key[1].as_py(), int(labels[0]), int(labels[-1]), k, kind, raw, ids.tobytes() if not k else None, labels.tobytes() if not k else None, groups))
        names = [f.split()[0] for f in ("dims", "at", "low", "high", "chunk", "kind", "part", "ids", "labels", "groups")]
        group = pa.list_(pa.struct([("no", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("part", pa.binary())]))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), group]
        return pa.table([pa.array([r[j] for r in out], kinds[j]) for j in range(len(names))], names)

    return scratch.keep(placed.groupBy("dims", "at").applyInArrow(cut, _BLOCKS), "blocks")


def _times(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's chunk times an anchor group's chunk: a tile of partial sums, anchors by rows, as 64-bit integers."""
    names = ["dims", "a", "no", "i", "tile", "ids", "labels", "anchors", "anchor_labels"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names)
    l, r = left.to_pylist()[0], right.to_pylist()[0]
    rows, anchors = len(l["part"]) // (l["wide"] * np.dtype(l["kind"]).itemsize), len(r["r_ids"]) // 8
    x = np.frombuffer(l["part"], l["kind"]).reshape(rows, -1)
    y = np.frombuffer(r["r_part"], r["r_kind"]).reshape(anchors, -1)
    bound = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * x.shape[1]
    if bound < 1 << 53:  # whole numbers below 2^53 are exact in doubles, and their sums in any order
        tile = (y.astype(float) @ x.astype(float).T).astype("<i8")
    else:
        tile = y.astype("<i8") @ x.astype("<i8").T
    row = (l["dims"], l["a"], l["no"], l["i"], tile.tobytes(), l["ids"], l["labels"], r["r_ids"], r["r_labels"])
    return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)


def _sum(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores, row ids, row labels, anchor ids, anchor labels) of a tile's partial sums."""
    rows = t.select(["tile", "ids", "labels", "anchors", "anchor_labels"]).to_pylist()
    whole = next(r for r in rows if r["ids"] is not None)
    ids, labels, anchors, own = (np.frombuffer(whole[c], "<i8") for c in ("ids", "labels", "anchors", "anchor_labels"))
    score = np.zeros((len(anchors), len(ids)), np.int64)
    for r in rows:
        score += np.frombuffer(r["tile"], "<i8").reshape(score.shape)
    return score, ids, labels, anchors, own


def mine(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256, every: int = 100, positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90, size: int = BLOCK, chunk: int = CHUNK, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row whose id is divisible by `every`)
    and each of its first `positives` other rows of the same label, the first `negatives` rows of other labels whose score is `low` to
    `high` per cent of the positive's. Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id.

    Rows in order of label are cut into blocks, and their components into chunks. Each pair of a block and a group of anchors is a tile:
    a cogroup multiplies the two for each chunk, and partial tiles of 64-bit sums are shuffled by tile and added. A
    tile of added scores gives its first rows of each anchor, or of each window of an anchor and positive, and these meet over all blocks.
    Blocks of one label give positives only, tiles of two labels negatives only, so that the whole matrix is worked out once: positives
    need the blocks that share a label, a range of neighbours; windows need the positives and come with the anchors to all other tiles. A tile
    has at most `size` rows and `anchors` anchors, however common a label or a vector is. Work is anchors times rows, as any exact search of a
    part of the rows against all is; the shuffle holds 8 bytes a pair and chunk before compression.

    Rows whose id, label or vector is null, or whose vector is empty or holds null or non-finite components, take no part. Vectors meet those of as
    many components. Rows equal in id, label and quantised vector are one; an id of several rows is a candidate with each, and asks with its
    least by components' number, label and bytes. An anchor is no candidate of its own by any row of its id. Positives equal in id and score
    are one. A negative positive score has no window, one of zero takes scores of zero. Scores are to fit 64 bits; what goes beyond wraps. An anchor
    without positives or negatives has no rows; an empty table gives an empty one. Extra columns are ignored.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "negatives")
    rows = scratch.keep(quantised(df, id_col, vector_col, scale, label_col), "rows")
    asking = F.col("vec_id") % every == 0
    one = Window.partitionBy("vec_id").orderBy("dims", "label", "vector")
    rows = rows.filter(asking).withColumn("asks", F.row_number().over(one) == 1).unionByName(rows.filter(~asking).withColumn("asks", F.lit(False)))
    cut = blocks(rows, scratch, size, chunk, anchors)

    heads = cut.filter("chunk = 0").select("dims", "at", "low", "high", F.size("groups").alias("n"))
    edges = heads.select("dims", "at", F.explode(F.array_distinct(F.array("low", "high"))).alias("label"))
    spans = scratch.keep(edges.groupBy("dims", "label").agg(F.min("at").alias("from"), F.max("at").alias("to")), "spans")
    begin = spans.select("dims", F.col("label").alias("low"), "from")
    end = spans.select("dims", F.col("label").alias("high"), "to")
    near = heads.join(begin, ["dims", "low"]).join(end, ["dims", "high"])
    all_blocks = heads.groupBy("dims").agg((F.max("at") + 1).alias("blocks"))
    whole = heads.join(all_blocks, "dims").select("dims", "at", "low", "high", "n", F.lit(0).cast("long").alias("from"), (F.col("blocks") - 1).alias("to"))
    pure = (F.col("low") == F.col("high")) & (F.col("o_low") == F.col("o_high")) & (F.col("low") == F.col("o_low"))

    def tiles(heads: DataFrame, keep) -> DataFrame:
        """(dims, a, no, i): groups of anchors, each with the blocks of its range that `keep` holds for."""
        pairs = heads.filter("n > 0").select("dims", F.col("at").alias("a"), "low", "high", "n", F.explode(F.sequence("from", "to")).alias("i"))
        other = cut.filter("chunk = 0").select("dims", F.col("at").alias("i"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
        pairs = pairs.join(other, ["dims", "i"]).filter(keep)
        return pairs.select("dims", "a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("no"), "i")

    def tasks(some: DataFrame) -> int:
        return max(1, min(TASKS, partitions(spark), some.count()))

    def scores(some: DataFrame, n: int) -> DataFrame:
        """Partial tiles of the given ones, dealt by tile."""
        wide = F.least(F.lit(chunk), F.col("dims") - F.col("chunk") * chunk).alias("wide")
        left = some.join(cut.select("dims", F.col("at").alias("i"), "chunk", wide, "kind", "part", "ids", "labels"), ["dims", "i"])
        groups = cut.select("dims", F.col("at").alias("a"), "chunk", "kind", F.explode("groups").alias("g"))
        right = some.join(groups.select("dims", "a", F.col("g.no").alias("no"), "chunk", "kind", F.col("g.part").alias("part"), F.col("g.ids").alias("ids"), F.col("g.labels").alias("labels")), ["dims", "a", "no"])
        keys = [*_TILE, "chunk"]
        right = right.toDF(*[f"r_{c}" for c in right.columns])
        pairs = left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *[f"r_{c}" for c in keys]).groupBy(*[f"r_{c}" for c in keys]))
        return pairs.applyInArrow(_times, "dims int, a long, no int, i long, tile binary, ids binary, labels binary, anchors binary, anchor_labels binary").repartition(n, *_TILE)

    def same(key: tuple, t: pa.Table) -> pa.Table:
        score, ids, labels, asked, own = _sum(t)
        row, at = highest(score, (own[:, None] == labels[None]) & (asked[:, None] != ids[None]), ids, positives)
        n = len(row)
        return pa.table([pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(np.full(n, key[1].as_py())), pa.array(np.full(n, key[2].as_py(), np.int32)), asked[row], ids[at], score[row, at]],
                        ["dims", "a", "no", "anchor_id", "positive_id", "positive_score"])

    some = scratch.keep(tiles(near, F.lit(True)), "near")
    found = scores(some, tasks(some)).groupBy(*_TILE).applyInArrow(same, "dims int, a long, no int, anchor_id long, positive_id long, positive_score long")
    found = limit_per(found, ["dims", "anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives).distinct()
    windows = found.groupBy("dims", "a", "no").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("windows"))
    windows = scratch.keep(windows, "windows")

    def other(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names)
        score, ids, labels, asked, own = _sum(left)
        held = right.column("windows").to_pylist()[0]
        place = {int(x): j for j, x in enumerate(asked)}
        line = np.array([place[w["anchor_id"]] for w in held])
        positive = np.array([w["positive_id"] for w in held], np.int64)
        value = np.array([w["positive_score"] for w in held], np.int64)
        least = np.array([-(-low * w["positive_score"] // 100) for w in held], object).clip(-(1 << 63), (1 << 63) - 1).astype(np.int64)
        most = np.array([high * w["positive_score"] // 100 for w in held], object).clip(-(1 << 63), (1 << 63) - 1).astype(np.int64)
        mine = score[line]
        row, at = highest(mine, (own[line][:, None] != labels[None]) & (mine >= least[:, None]) & (mine <= most[:, None]), ids, negatives)
        return pa.table([asked[line][row], positive[row], value[row], ids[at], mine[row, at]], names)

    some = scratch.keep(tiles(whole, ~pure).join(windows.select("dims", "a", "no"), ["dims", "a", "no"]), "far")
    n = tasks(some)
    asked = some.join(windows, ["dims", "a", "no"]).select(*[F.col(c).alias(f"w_{c}") for c in _TILE], "windows")
    asked = asked.repartition(n, *[f"w_{c}" for c in _TILE]).groupBy(*[f"w_{c}" for c in _TILE])
    hard = scores(some, n).groupBy(*_TILE).cogroup(asked).applyInArrow(other, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", place).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")))
