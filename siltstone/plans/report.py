"""Reports: inventory summary, static-analysis interchange rows and JSON, scan history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import exprs
from siltstone.operators import rollup
from siltstone.operators.score import limit_per

#: Newest scans that stay in the history, validations shown with a result. Fixed values.
KEPT_SCANS, SHOWN_VALIDATIONS = 500, 5


def cbom_summary(enriched: DataFrame) -> DataFrame:
    """One row of counts and the distinct algorithms."""
    severities = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    return enriched.agg(F.count(F.lit(1)).alias("total"), F.count_if("mosca_exposed").alias("exposed"), *severities, rollup.joined("algorithm").alias("algorithms"))


def sarif_rules(enriched: DataFrame) -> DataFrame:
    """One rule per algorithm; the first finding gives its severity."""
    return enriched.groupBy(F.col("algorithm").alias("rule")).agg(F.min_by("severity", "ord").alias("severity"))


def sarif_results(enriched: DataFrame, *more) -> DataFrame:
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    return enriched.select("ord", F.col("algorithm").alias("rule"), level.alias("level"), F.col("file_path").alias("uri"), F.greatest(F.lit(1), "line").alias("line"), *more)


def sarif_json(enriched: DataFrame, validations: DataFrame | None = None) -> DataFrame:
    """(ord, json): a result of the interchange format per finding, written line by line; at most five validations each."""
    more = ["id", F.col("evidence") if "evidence" in enriched.columns else F.lit("").alias("evidence")]
    rows = sarif_results(enriched, *more)
    if validations is not None:
        first = limit_per(validations.select("finding_id", "validation_id"), ["finding_id"], ["validation_id"], SHOWN_VALIDATIONS)
        shown = first.groupBy("finding_id").agg(F.array_sort(F.collect_list("validation_id")).alias("validations"))
        rows = rows.join(shown, F.col("id") == F.col("finding_id"), "left")
    else:
        rows = rows.withColumn("validations", F.array().cast("array<string>"))
    body = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.coalesce("evidence", F.lit("")).alias("text")).alias("message"),
                    F.array(F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
                    F.struct(F.col("id").alias("findingId"), F.coalesce("validations", F.array().cast("array<string>")).alias("validations")).alias("properties"))
    return rows.select("ord", F.to_json(body).alias("json"))


def store_scan(enriched: DataFrame, path: str, scan_id: str, timestamp: float) -> None:
    """Writes a scan to the history, a folder of Parquet partitioned by scan. A scan of the same name is replaced, so a retry repeats nothing."""
    rows = enriched.withColumns({"scan_id": F.lit(scan_id), "scan_time": F.lit(timestamp)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def history(spark: SparkSession, path: str, most: int | None = KEPT_SCANS) -> DataFrame:
    """(scan_id, scan_time, findings, critical, high) of the newest scans (None: all), newest first."""
    rows = spark.read.parquet(path)
    index = rows.groupBy("scan_id").agg(F.max("scan_time").alias("scan_time"), F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    index = index.orderBy(F.desc("scan_time"), "scan_id")
    return index if most is None else index.limit(most)


def history_with_legacy(durable: DataFrame, legacy: DataFrame) -> DataFrame:
    """Stored scans, and those of memory that aren't stored: by scan_id."""
    return durable.unionByName(legacy.join(durable.select("scan_id"), "scan_id", "left_anti").select(*durable.columns))


#: Form of a scan's name, and scopes of snapshots that stay. Fixed values.
SCAN_ID, KEPT_SCOPES = "^[A-Za-z0-9_-]{1,64}$", 5


def repaired_index(records: DataFrame, most: int | None = KEPT_SCANS) -> DataFrame:
    """(path, state, scan_id, scan_time) of stored records (path, text): the newest ones are indexed, older ones expired; what isn't an
    object with a report, or has a bad name, is quarantined instead of breaking the index."""
    fields = "id string, timestamp double, report map<string,string>"
    read = records.withColumn("r", F.from_json("text", fields, {"mode": "PERMISSIVE"}))
    good = F.col("r.report").isNotNull() & F.coalesce(F.col("r.id"), F.lit("")).rlike(SCAN_ID)
    rows = read.select("path", F.coalesce(good, F.lit(False)).alias("good"), F.col("r.id").alias("scan_id"), F.coalesce("r.timestamp", F.lit(0.0)).alias("scan_time"))
    kept = rows.where("good") if most is None else rows.where("good").orderBy(F.desc("scan_time"), "scan_id").limit(most)
    state = F.when(~F.col("good"), "quarantined").when(F.col("kept"), "indexed").otherwise("expired")
    out = rows.join(kept.select("path", F.lit(True).alias("kept")), "path", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return out.select("path", state.alias("state"), F.when(F.col("good"), F.col("scan_id")).alias("scan_id"), "scan_time")


def without_scan(index: DataFrame, scan_id: str) -> DataFrame:
    return index.where(F.col("scan_id") != scan_id)


def pruned_scopes(notes: DataFrame, keep: int = KEPT_SCOPES) -> DataFrame:
    """(scope, action) of snapshot notes (scope, path, managed): the newest `keep` scopes stay, older ones go only if all their notes are
    managed and there are some. The scope "current" is none."""
    scopes = notes.where("scope <> 'current'").groupBy("scope").agg(F.bool_and("managed").alias("managed"))
    newest = scopes.select("scope").orderBy(F.desc("scope")).limit(keep).withColumn("kept", F.lit(True))
    return scopes.join(newest, "scope", "left").select("scope", F.when(F.col("kept"), "kept").when(F.col("managed"), "removed").otherwise("skipped").alias("action"))


def scan_counts(findings: DataFrame, code_findings: DataFrame) -> DataFrame:
    """(scan_id, crypto, critical, high, code, total) by scan."""
    crypto = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("crypto"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    code = code_findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("code"))
    both = crypto.join(code, "scan_id", "full").na.fill(0)
    return both.withColumn("total", F.col("crypto") + F.col("code"))


def relativized(findings: DataFrame, root: str, prefix: str) -> DataFrame:
    """Findings with paths below the root, or relative ones, put below a logical prefix, their ids and fingerprints worked out anew;
    old_id and old_path lead to the links that name them. Absolute paths elsewhere stay."""
    below, inside = root.rstrip("/") + "/", F.col("file_path").startswith(root.rstrip("/") + "/")
    path = F.when(inside, F.concat(F.lit(prefix + "/"), F.substring("file_path", len(below) + 1, 1 << 30))).when(F.col("file_path").startswith("/"), F.col("file_path")).otherwise(F.concat(F.lit(prefix + "/"), "file_path"))
    rows = findings.withColumns({"old_id": F.col("id"), "old_path": F.col("file_path"), "file_path": path})
    return rows.withColumns({"id": exprs.finding_id(), "fp": exprs.finding_fingerprint()})


def remapped(links: DataFrame, findings: DataFrame, *columns: str) -> DataFrame:
    """Links with the new ids of relativized findings in place of the old ones: one left join for each column."""
    names = findings.select("old_id", F.col("id").alias("new_id")).where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    for c in columns:
        links = links.join(names.withColumnRenamed("old_id", "_old"), F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("new_id", c)).drop("_old", "new_id")
    return links


def cbom_json(enriched: DataFrame) -> DataFrame:
    """(json): one document of summary, recommendations in the order first seen, and inventory; findings stay a table of their own."""
    summary = cbom_summary(enriched).select(F.struct("*").alias("summary"))
    seen = enriched.groupBy("recommend").agg(F.min("ord").alias("first")).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "recommend"))), lambda x: x["recommend"]).alias("recommendations"))
    families = rollup.inventory(enriched).agg(F.array_sort(F.collect_list(F.struct("family", "findings", "severity", "priority"))).alias("inventory"))
    return summary.join(F.broadcast(seen)).join(F.broadcast(families)).select(F.to_json(F.struct("summary", "recommendations", "inventory")).alias("json"))


def read_scan(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """One scan: only its partition is read."""
    return spark.read.parquet(path).where(F.col("scan_id") == scan_id)
