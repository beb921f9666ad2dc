"""Comparison of two scans, of two graphs, and of a code analysis before and after a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: From mildest, for comparison. Fixed values.
SEVERITY_LEVELS = ["low", "medium", "high", "critical"]


def level(c) -> F.Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY_LEVELS)), F.col(c)), F.lit(0))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, id, after_id, before_severity, after_severity) of two scans with columns id, fp, severity, ord.

    An id in both is unchanged. The n-th id of a fingerprint that is gone pairs with the n-th candidate of that fingerprint
    (ids of the second scan: those that the first has too in its order, then the others in theirs): changed. The rest are
    resolved or new; candidates that were paired are not new. As an id determines its fingerprint, joining by rank gives what
    serving one after the other gives. Of rows that repeat an id, the last one's values count.
    """
    last = lambda df: df.groupBy("id").agg(F.max_by(F.struct("fp", "severity"), "ord").alias("r"), F.min("ord").alias("first"))
    b, a = last(before), last(after)
    both = b.select("id", F.col("r").alias("b"), F.col("first").alias("b_first")).join(a.select("id", F.col("r").alias("a"), F.col("first").alias("a_first")), "id", "full")
    kept, gone, fresh = both.where("b is not null and a is not null"), both.where("a is null"), both.where("b is null")
    removed = gone.select("id", F.col("b.fp").alias("fp"), F.col("b.severity").alias("before_severity"), F.row_number().over(Window.partitionBy("b.fp").orderBy("id")).alias("n")).where("fp <> ''")
    candidates = kept.select(F.col("b.fp").alias("fp"), F.col("id").alias("after_id"), F.col("a.severity").alias("after_severity"), F.lit(0).alias("k"), F.col("b_first").alias("o")).union(
        fresh.select(F.col("a.fp").alias("fp"), "id", F.col("a.severity"), F.lit(1), "a_first"))
    candidates = candidates.withColumn("n", F.row_number().over(Window.partitionBy("fp").orderBy("k", "o"))).drop("k", "o")
    pairs = removed.join(candidates, ["fp", "n"], "left")
    none = F.lit(None).cast("string")
    changed = pairs.where("after_id is not null").select(F.lit("changed").alias("change"), "id", "after_id", "before_severity", "after_severity")
    unpaired = gone.join(pairs.where("after_id is not null").select("id"), "id", "left_anti").select(F.lit("resolved"), "id", none, F.col("b.severity"), none)
    new = fresh.join(pairs.where("after_id is not null").select(F.col("after_id").alias("id")), "id", "left_anti").select(F.lit("new"), "id", none, none, F.col("a.severity"))
    same = kept.select(F.lit("unchanged"), "id", none, F.col("b.severity"), F.col("a.severity"))
    return changed.union(unpaired).union(new).union(same)


def regressions(delta: DataFrame) -> DataFrame:
    """Unchanged or moved findings whose severity rose."""
    return delta.where(F.col("change").isin("unchanged", "changed") & (level("after_severity") > level("before_severity")))


def verification(before: DataFrame, after: DataFrame, touched: list[str] | None = None) -> DataFrame:
    """(status, resolved, remains, regressions, unrelated_new): ids of findings (id, file_path) that went, stayed and came; those that came
    count as regressions only in touched files, if any are given."""
    inside = F.col("file_path").isin(touched) if touched else F.lit(True)
    b, a = before.where("id <> ''").select("id").distinct().withColumn("b", F.lit(1)), after.where("id <> ''").groupBy("id").agg(F.bool_or(inside).alias("a"))
    came = F.col("b").isNull()
    counts = b.join(a, "id", "full").agg(F.count_if(F.col("a").isNull()).alias("resolved"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("remains"),
                                         F.count_if(came & F.col("a")).alias("regressions"), F.count_if(came & ~F.col("a")).alias("unrelated_new"))
    status = F.when(F.col("remains") > 0, "REMAINS").when(F.col("regressions") > 0, "REGRESSION").when(F.col("resolved") > 0, "RESOLVED").otherwise("INCONCLUSIVE")
    return counts.select(status.alias("status"), "resolved", "remains", "regressions", "unrelated_new")


def graph_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, id) of nodes or edges keyed by id: added, removed, or changed in another column (nulls equal)."""
    others = [c for c in before.columns if c != "id"]
    both = before.select("id", F.struct(*others).alias("b")).join(after.select("id", F.struct(*others).alias("a")), "id", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(change.alias("change"), "id").where("change is not null")
