"""Deduplication, scoring, ranking and filters of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import exprs
from siltstone.sources.shared import fresh

#: Columns on which two findings are the same.
IDENTITY = ["scanner", "file_path", "line", "algorithm", "category", "key_size", "mode", "library", "curve", "usage"]
#: Years of data lifetime, of migration, and left.
HORIZON = (10.0, 3.0, 10.0)


def dedupe(findings: DataFrame, order: str = "ord") -> DataFrame:
    """The first row by `order` of each set of equal findings (nulls equal); aggregated before the shuffle."""
    others = [c for c in findings.columns if c not in IDENTITY]
    first = findings.groupBy(*IDENTITY).agg(F.min(F.struct(order, *[c for c in others if c != order])).alias("_first"))
    return first.select(*IDENTITY, *[F.col(f"_first.{c}").alias(c) for c in others]).select(*findings.columns)


def assess(findings: DataFrame, horizon: tuple[float, float, float] = HORIZON) -> DataFrame:
    """Adds mosca_exposed, severity, priority_score, risk_factors, priority: a projection."""
    name, size = F.col("algorithm"), F.col("key_size")
    return (findings.withColumn("mosca_exposed", exprs.exposed(name, horizon))
            .withColumn("severity", exprs.severity(name, size, F.col("mosca_exposed")))
            .withColumn("priority_score", exprs.priority_score(name, size, F.col("mosca_exposed")))
            .withColumn("risk_factors", exprs.risk_factors(name, size, F.col("mosca_exposed")))
            .withColumn("priority", exprs.priority(F.col("priority_score"))))


def enrich(findings: DataFrame, horizon: tuple[float, float, float] = HORIZON) -> DataFrame:
    """assess, and id, fingerprint, family, recommendation, evidence strength, migration status: still a projection."""
    name = F.col("algorithm")
    return assess(findings, horizon).withColumns({
        "id": exprs.finding_id(), "fp": exprs.finding_fingerprint(), "family": exprs.family(name),
        "recommend": exprs.recommendation(exprs.base_algorithm(name)), "strength": exprs.evidence_strength(F.col("usage"), F.col("confidence")),
        "status": exprs.migration_status(F.col("severity"), F.col("priority")), "bucket": exprs.roadmap_bucket(F.col("severity"), F.col("priority"))})


def by_urgency(findings: DataFrame) -> DataFrame:
    """Order of a report."""
    return findings.orderBy(F.col("priority_score").desc(), "file_path", "line", "algorithm", "ord")


def urgency_places(findings: DataFrame) -> DataFrame:
    """All findings with their place in the order of a report, from 1: sorted by range over the cluster, numbered by sums over ranges."""
    order = [F.col("priority_score").desc(), F.col("file_path"), F.col("line"), F.col("algorithm"), F.col("ord")]
    return numbered(findings, order, "place")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place of each row in a total order, from 1, without bringing the rows to one task.

    Rows are sorted by sampled ranges and written once, in the shared folder: evaluated twice, a sort by range may cut its ranges at other
    places. A row's place is its place in its range plus the sizes of the ranges before, of which there is one row each.
    """
    spark = df.sparkSession
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), fresh(spark, "numbered")
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_m", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))  # at most n rows
    place = F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(base), "_part").withColumn(name, place.cast("long")).drop("_part", "_m", "_before")


def top(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.orderBy(exprs.rank(F.col("priority"), exprs.PRIORITIES, 3), "id", "ord").limit(n)


def matching(findings: DataFrame, text: str = "", **equal: str) -> DataFrame:
    """Rows with the given column values that hold the text (any case) in one of the searched columns."""
    for column, value in equal.items():
        findings = findings.where(F.col(column) == value)
    words = F.lower(F.concat_ws(" ", "algorithm", "library", "file_path", "usage", "scanner", "category", "severity", "priority", "family"))
    return findings.where(words.contains(text.strip().lower())) if text.strip() else findings


def limit_per(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a task below the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
