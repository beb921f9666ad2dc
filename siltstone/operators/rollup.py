"""Aggregations of findings: inventory, migration work items and roadmap, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import exprs

ARTIFACTS_SHOWN, WORK_ARTIFACTS = 50, 20


def worst(column: str, order: list[str]) -> F.Column:
    """The most urgent value of a column; an unknown one ranks as the mildest."""
    c = F.col(column)
    return F.min_by(c, exprs.rank(c, order, 3))


def joined(column: str) -> F.Column:
    """Distinct values in order, as text."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def inventory(enriched: DataFrame) -> DataFrame:
    """One row per family. Paths are made distinct by an aggregation of their own, so that a family's state stays small."""
    strengths = F.min(exprs.rank(F.col("strength"), ["HIGH", "MEDIUM", "LOW"], 2))
    main = enriched.groupBy("family").agg(
        F.count(F.lit(1)).alias("findings"), joined("algorithm").alias("algorithms"), joined("scanner").alias("scanners"),
        worst("severity", exprs.SEVERITIES).alias("severity"), worst("priority", exprs.PRIORITIES).alias("priority"),
        F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), strengths + 1).alias("evidence"), F.bool_or(F.col("scanner") == "runtime").alias("runtime"))
    paths = enriched.select("family", "file_path").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("artifacts"))
    return main.join(paths, "family").withColumn("recommend", exprs.recommendation(F.col("family")))


def artifacts(enriched: DataFrame, n: int = ARTIFACTS_SHOWN) -> DataFrame:
    """(family, file_path): the first n paths of each family."""
    from siltstone.operators.score import limit_per

    return limit_per(enriched.select("family", "file_path").distinct(), ["family"], ["file_path"], n)


def work_items(enriched: DataFrame) -> DataFrame:
    """One row per family: the most urgent member (first of equals), status, flags, direction."""
    urgency = F.struct(exprs.rank(F.col("priority"), exprs.PRIORITIES, 3).alias("p"), exprs.rank(F.col("severity"), exprs.SEVERITIES, 3).alias("s"), F.col("ord").alias("o"))
    return enriched.groupBy("family").agg(
        F.count(F.lit(1)).alias("findings"), F.min_by(F.struct("priority", "severity", "ord"), urgency).alias("w"),
        F.min_by("status", exprs.rank(F.col("status"), exprs.STATUSES, 9)).alias("status"), F.min_by("bucket", exprs.rank(F.col("bucket"), exprs.BUCKETS, 3)).alias("bucket"),
        F.bool_or(F.col("scanner") == "hsm").alias("hsm"), F.bool_or(F.col("scanner") == "cloud").alias("cloud"), F.bool_or(F.col("scanner") == "runtime").alias("runtime"),
    ).select(exprs.digest("", 12, F.concat(F.lit("migrate:"), F.col("family"))).alias("id"), "family", "findings", F.col("w.priority").alias("priority"), F.col("w.severity").alias("severity"),
             F.col("w.ord").alias("worst_ord"), "status", "bucket", "hsm", "cloud", "runtime", exprs.recommendation(F.col("family")).alias("direction"))


def roadmap(items: DataFrame) -> DataFrame:
    return items.groupBy("bucket").agg(F.count(F.lit(1)).alias("items"), joined("id").alias("ids"))


def tally(enriched: DataFrame, *columns: str) -> DataFrame:
    return enriched.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def display_families(enriched: DataFrame) -> DataFrame:
    """The front end's family list."""
    rows = enriched.withColumn("shown", exprs.display_family(F.col("algorithm")))
    return rows.groupBy("shown").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity").isin("critical", "high")).alias("critical_high"), F.count_if(F.col("library") != "").alias("with_library"))


def health(code_findings: DataFrame) -> DataFrame:
    """Score out of 100 of code findings: the share without high confidence, rounded half to even."""
    return code_findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "HIGH").alias("high")).withColumn(
        "score", F.bround(100 * (1 - F.col("high") / F.greatest("n", F.lit(1)))).cast("int"))
