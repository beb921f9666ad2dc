"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import WORD, Scratch, load, unit_hash

#: Ranks are cut into so many coarse parts, and the part that holds the border into as many fine ones.
PARTS = 1024


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size) -> also target: shares of the total by weight, no target above cap times its source's size,
    what is in excess shared again by weight. Sources get the weights in turn by code point, null last.

    The level m with sum(min(cap * size, m * weight)) = total is found in closed form: sources sorted by size over weight
    are at their cap up to some place, and m follows from those behind it. One row a source is all that is sorted here.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    most, order = cap * F.col("source_size"), Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    open_from = weighed.withColumns({
        "_before": F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "_total": F.sum("source_size").over(Window.partitionBy(F.lit(0))),
    }).withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_weights"))
    first = F.struct((F.col("source_size") / F.col("weight")).alias("order"), F.col("_level").alias("level"))
    level = F.min(F.when(F.col("_level") * F.col("weight") <= most, first)).over(Window.partitionBy(F.lit(0)))
    return open_from.withColumn("_level", level["level"]).select(
        "source", "source_size", F.least(most.cast("double"), F.coalesce(F.col("_level") * F.col("weight"), most)).cast("double").alias("target"))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
        cap: int = 3, size_power: float = 0.5, seed: int = 20_001) -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, copies, taken (copies times size).

    A document of size s is expected copies(s) = min(cap, m * s ** size_power) times; m of its source makes the expected
    words equal the target. The whole part of that is certain. The rest is the inclusion probability p of one further
    copy: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u uniform from a hash of id, source and seed, and the
    first of the ranking are taken as long as their words fit what the whole copies left open, then the first of those behind
    that still fit; the last place goes to the document whose size comes nearest to the rest, so that the sample's size in
    words is fixed. A border is found by sums over parts of the ranking, coarse, then fine; only
    the rows of one fine part (a millionth of a source, about) are sorted together.

    Null text: size 0. Documents of size 0 are never taken. Rows that repeat an id in a source share u: equal rows are
    taken or left together. Null ids and sources are values like any other. Extra columns are ignored.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "mix")
    rows = scratch.keep(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                  F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "rows")
    sizes = scratch.keep(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    aims = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap)

    aims = scratch.keep(aims, "aims")
    pull = F.pow(F.col("size").cast("double"), F.lit(size_power))
    order = Window.partitionBy("source").orderBy(F.col("size").desc())
    held = sizes.filter("size > 0").join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    held = held.withColumns({
        "_capped": F.coalesce(F.sum(cap * F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_open": F.sum(pull * F.col("size") * F.col("n")).over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("_m", (F.col("target") - F.col("_capped")) / F.col("_open"))
    pace = held.groupBy("source").agg(F.max_by(F.when(F.col("_m") * pull <= cap, F.col("_m")), F.when(F.col("_m") * pull <= cap, F.col("size"))).alias("pace"))
    pace = scratch.keep(aims.join(pace.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "pace")

    expected = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.coalesce(F.col("pace") * pull, F.lit(float(cap)))))
    named = pace.withColumnRenamed("source", "_s")
    u = unit_hash(seed, F.col("doc_id"), F.col("source"))
    ranked = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_e", expected)
    ranked = ranked.withColumns({"_whole": F.floor("_e"), "_p": F.col("_e") - F.floor("_e")})
    ranked = ranked.withColumn("_odds", F.when(F.col("_p") > 0, u / (1 - u) * (1 - F.col("_p")) / F.col("_p")))
    ranked = scratch.keep(ranked.withColumn("_part", F.floor(F.col("_odds") / (1 + F.col("_odds")) * (PARTS * PARTS)).cast("int")).drop("_e", "_p"), "ranked")

    left = scratch.keep(ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("size"))).alias("open")).filter("open > 0"), "left")
    running = Window.partitionBy("source").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    exact = Window.partitionBy("source").orderBy("_odds", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("_odds", F.coalesce("doc_id", F.lit((1 << 63) - 1).cast(df.schema[id_col].dataType)).alias("i"))

    def border(parts: DataFrame, limits: DataFrame) -> DataFrame:
        """(source, _cut, words) and (source, open) -> per source the part in which the running sum passes open, and the rest of open."""
        at = parts.join(limits.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        at = at.withColumn("_before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        at = at.filter((F.col("_before") <= F.col("open")) & (F.col("_before") + F.col("words") > F.col("open")))
        return at.select(F.col("source").alias("_s"), F.col("_cut").alias("_at"), (F.col("open") - F.col("_before")).alias("open"))

    def take(some: DataFrame, limits: DataFrame, name: str) -> DataFrame:
        """Of candidates and (source, open): (_s, _border, _last, _rest): the first of the ranking that fit are those of parts before
        _border, and of _border up to _last; _rest is what they leave open. Without a border all fit."""
        coarse = scratch.keep(border(some.groupBy("source", F.expr(f"_part div {PARTS}").alias("_cut")).agg(F.sum("size").alias("words")), limits), f"{name}-coarse")
        inside = some.join(coarse, F.col("source").eqNullSafe(F.col("_s")) & (F.expr(f"_part div {PARTS}") == F.col("_at"))).drop("_s", "_at", "open")
        fine = border(inside.groupBy("source", F.col("_part").alias("_cut")).agg(F.sum("size").alias("words")), coarse.select(F.col("_s").alias("source"), "open"))
        fine = scratch.keep(fine, f"{name}-fine")
        inside = some.join(fine, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_at"))).withColumn("_sum", F.sum("size").over(exact))
        ends = inside.filter(F.col("_sum") <= F.col("open")).groupBy("source").agg(F.max(place).alias("_last"), F.max("_sum").alias("_sum"))
        whole = some.groupBy("source").agg(F.sum("size").alias("_words")).withColumnRenamed("source", "_w")
        out = limits.join(fine.select("_s", F.col("_at").alias("_border"), F.col("open").alias("_left")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        out = out.join(ends.withColumnRenamed("source", "_e"), F.col("source").eqNullSafe(F.col("_e")), "left").join(whole, F.col("source").eqNullSafe(F.col("_w")), "left")
        rest = F.when(F.col("_border").isNotNull(), F.col("_left") - F.coalesce("_sum", F.lit(0))).otherwise(F.col("open") - F.coalesce("_words", F.lit(0)))
        return scratch.keep(out.select(F.col("source").alias("_s"), "_border", "_last", rest.alias("_rest")), name)

    def marked(rows: DataFrame, ends: DataFrame, may: F.Column) -> DataFrame:
        fits = F.col("_border").isNull() | (F.col("_part") < F.col("_border")) | ((F.col("_part") == F.col("_border")) & F.col("_last").isNotNull() & (place <= F.col("_last")))
        out = rows.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
        more = F.when(may & F.col("_s").isNotNull() & fits, 1).otherwise(F.col("_more"))
        return out.withColumn("_more", more).drop("_s", "_border", "_last")

    # The first of the ranking that fit; then the first of those behind that fit what is left; then the one that closes the gap best.
    able = F.col("_odds").isNotNull() & (F.col("_more") == 0)
    ranked = ranked.withColumn("_more", F.lit(0))
    first = marked(ranked, take(ranked.filter(able), left, "first"), able)
    first = scratch.keep(first, "taken")
    small = able & (F.col("size") <= F.col("_rest"))
    gaps = scratch.keep(first.filter("_rest > 0").select("source", F.col("_rest").alias("open")).distinct(), "gaps")
    second = take(first.filter(small).drop("_rest"), gaps, "second")
    out = scratch.keep(marked(first.withColumn("_small", small).drop("_rest"), second, able & F.coalesce("_small", F.lit(False))), "out")
    miss = F.abs(F.col("size") - F.col("_rest"))
    close = out.filter(able & (miss < F.col("_rest"))).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), place.alias("at"))).alias("_close"))
    out = out.join(close.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    copies = (F.col("_whole") + F.when(able & (place == F.col("_close.at")), 1).otherwise(F.col("_more"))).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
