"""Whole JSON documents of any size: a header, body rows in order, a footer, each written where it lies.

A document is a folder: `part` files in order of name, and an index of their lengths; put end to end, and unpacked where they are gzip files, they are
one JSON text. No task and no driver holds the body.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import exprs
from siltstone.operators import rollup
from siltstone.operators.score import limit_per
from siltstone.plans.report import SHOWN_VALIDATIONS
from siltstone.sources.shared import Folder, kept

#: Severities as numbers and levels of the interchange format, longest texts and paths in it, its version and schema. Fixed values.
SECURITY = {"critical": "9.0", "high": "7.5", "medium": "5.0", "low": "2.5"}
LONGEST_TEXT, LONGEST_URI = 1000, 512
SARIF = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}


def write(rows: DataFrame, order: list, path: str, head: str, tail: str, parts: int | None = None, body: Column | None = None, packed: bool = False) -> DataFrame:
    """Writes head, the column `json` of rows in order with commas between, and tail; returns the index (no, file, rows, bytes).

    Rows are dealt by range and sorted within, so parts are the order's own pieces. A row's line starts with its comma, but for the first of
    all: where a part begins with the least order, which an aggregate finds before. The same rows in another cluster give the same text.
    With body, a row's JSON, the rows travel as they are and become JSON where they are written. packed: parts of the body are gzip files.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.to_json(F.struct(*order))
    least = rows.agg(F.to_json(F.min(F.struct(*order))).alias("least")).first().least
    lines = rows.repartitionByRange(n, *order)  # rows of one order share a part
    lines = (lines if body is None else lines.withColumn("json", body)).sortWithinPartitions(*order, "json")
    begins = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines = lines.withColumn("comma", F.when(begins & (own == F.lit(least)), "").otherwise(","))
    how = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"} if packed else {}
    lines.select(F.concat("comma", "json").alias("value")).write.mode("overwrite").options(**how).text(f"{path}/body")
    folder = Folder(spark, path)
    for name in ("head", "tail", "index.json"):
        folder.delete(name)
    folder.create("head", head + "\n")
    folder.create("tail", tail + "\n")
    body = [f"body/{f}" for f in folder.names("body") if f.startswith("part-")]
    sizes = [(k, f, folder._fs.getFileStatus(folder._at(f)).getLen()) for k, f in enumerate(["head", *body, "tail"])]  # one row a part
    folder.create("index.json", json.dumps([{"no": k, "file": f, "bytes": b} for k, f, b in sizes]))
    return spark.createDataFrame(sizes, "no int, file string, bytes long")


def text(spark: SparkSession, path: str) -> str:
    """A document as one string, for those that fit the driver."""
    folder = Folder(spark, path)
    return "".join(folder.read(p["file"]) for p in sorted(json.loads(folder.read("index.json")), key=lambda p: p["no"]))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(json): the body rows of a document, read in parallel."""
    return spark.read.text(f"{path}/body").select(F.regexp_replace("value", "^,", "").alias("json"))


def placed_lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """(place, r): the given fields of each body row, with the row's place in the document, from 1.

    Nothing is sorted or shuffled: a task reads a file, or a block of one, in order, so a row's place is its place there plus the rows of the files and
    blocks before. The fields are written once, in the shared folder: read twice, files may be dealt to tasks in another way.
    """
    at = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_begin"), F.monotonically_increasing_id().alias("_m")]
    read = spark.read.text(f"{path}/body").select(*at, F.from_json(F.regexp_replace("value", "^,", ""), fields).alias("r"))
    rows = kept(read, "placed")
    blocks = rows.groupBy("_file", "_begin").agg(F.count(F.lit(1)).alias("_size"), F.min("_m").alias("_first"))
    before = Window.orderBy("_file", "_begin").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("_file", "_begin", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))  # one row a block
    return rows.join(F.broadcast(base), ["_file", "_begin"]).select((F.col("_base") + F.col("_m")).cast("long").alias("place"), "r")


def _cut(c: Column | str, n: int) -> Column:
    return F.substring(c, 1, n)


def sarif_rule_rows(enriched: DataFrame) -> DataFrame:
    """One rule for each algorithm, of its first finding; with the JSON of the interchange format."""
    first = enriched.groupBy("algorithm").agg(F.min_by(F.struct("category", "severity", *(["rationale"] if "rationale" in enriched.columns else [])), "ord").alias("f"))
    rationale = F.coalesce(F.col("f.rationale"), F.lit("")) if "rationale" in enriched.columns else F.lit("")
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SECURITY.items() for x in p]), F.col("f.severity")), F.lit("2.5"))
    body = F.struct(F.concat(F.lit("CRYPTO-"), F.replace("algorithm", F.lit(" "), F.lit("-"))).alias("id"), F.concat(F.lit("Crypto usage: "), "algorithm").alias("name"),
                    F.struct(F.concat("algorithm", F.lit(" ("), "f.category", F.lit(")")).alias("text")).alias("shortDescription"), F.struct(_cut(rationale, LONGEST_TEXT).alias("text")).alias("fullDescription"),
                    F.struct(score.alias("security-severity")).alias("properties"))
    return first.select("algorithm", F.to_json(body).alias("json"))


def sarif_results(enriched: DataFrame, validations: DataFrame | None = None, source: str = "", properties: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """Findings with their first validations by the order they are given (`seq`); and the JSON that one becomes: level, message, place and properties,
    among these the given columns of the finding, beside the fixed ones."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    message = F.coalesce(*([F.when(F.col("rationale") != "", F.col("rationale"))] if "rationale" in enriched.columns else []), "algorithm")
    rows = enriched
    if validations is not None:
        shown = limit_per(validations.where("finding_id <> ''"), ["finding_id"], ["seq"], SHOWN_VALIDATIONS)
        seen = F.struct(F.col("observed_algorithm"), F.col("observed_protocol"), F.col("observed_cipher"), F.col("observed_key_size"))
        one = F.struct("seq", F.struct("validation_id", F.col("v_status").alias("status"), F.col("validation_type").alias("type"), seen.alias("observed")).alias("v"))
        held = shown.groupBy("finding_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["v"]).alias("validations"))
        rows = rows.join(held, rows["id"] == held["finding_id"], "left")
    else:
        rows = rows.withColumn("validations", F.lit(None).cast("array<string>"))
    status = F.coalesce(F.col("validation_status"), F.lit("STATIC_ONLY")) if "validation_status" in enriched.columns else F.lit("STATIC_ONLY")
    own = F.struct(F.col("id").alias("finding_id"), "severity", status.alias("validationStatus"), F.when(F.lit(source) != "", F.lit(source)).alias("source"))
    region = F.struct(F.greatest(F.lit(1), F.coalesce("line", F.lit(1))).alias("startLine"))
    place = F.struct(F.struct(F.struct(_cut("file_path", LONGEST_URI).alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    body = F.struct(F.concat(F.lit("CRYPTO-"), F.replace("algorithm", F.lit(" "), F.lit("-"))).alias("ruleId"), level.alias("level"), F.struct(_cut(message, LONGEST_TEXT).alias("text")).alias("message"),
                    F.array(place).alias("locations"), F.struct(own.alias("crypto"), "validations", *properties).alias("properties"))
    return rows, F.to_json(body, {"ignoreNullFields": "true"})


def sarif_result_rows(enriched: DataFrame, validations: DataFrame | None = None, source: str = "") -> DataFrame:
    """(ord, json) of each finding."""
    rows, body = sarif_results(enriched, validations, source)
    return rows.select("ord", body.alias("json"))


def write_sarif(enriched: DataFrame, path: str, validations: DataFrame | None = None, tool: str = "siltstone", version: str = "0.1", provenance: dict | None = None, properties: tuple[str, ...] = ()) -> DataFrame:
    """The interchange document of a scan: one run with its tool and rules in the header, results as the body, and the revision scanned in the footer.
    properties: columns of the findings that stand among a result's properties."""
    rules = [r.json for r in sarif_rule_rows(enriched).orderBy("json").collect()]  # one row an algorithm known to the rules
    driver = f'{{"name": {json.dumps(tool)}, "version": {json.dumps(version)}, "rules": [{",".join(rules)}]}}'
    head = f'{{"version": "{SARIF["version"]}", "$schema": "{SARIF["$schema"]}", "runs": [{{"tool": {{"driver": {driver}}}, "results": ['
    given = provenance or {}
    held = [{"repositoryUri": given.get("canonical_url", ""), "revisionId": given["sha"], "properties": {k: given.get(k, "") for k in ("ref_requested", "profile")}}] if given.get("sha") else []
    tail = "]" + (f', "versionControlProvenance": {json.dumps(held)}' if held else "") + "}]}"
    label = f"{given.get('owner')}/{given.get('repo')}@{given['sha'][:12]}" if given.get("sha") else ""
    rows, body = sarif_results(enriched, validations, label, properties)
    return write(rows, ["ord"], path, head, tail, body=body, packed=True)


def cbom_header(enriched: DataFrame, target: str, scanned_at: str, scanners: list[str] | None = None) -> dict:
    """Everything of a bill of materials but its components: a few aggregates, of one row or one a severity, algorithm or recommendation."""
    mock = F.count_if("is_mock") if "is_mock" in enriched.columns else F.lit(0)
    counts = enriched.agg(F.count(F.lit(1)).alias("total"), mock.alias("mock"), F.count_if("mosca_exposed").alias("exposed"), *[F.count_if(F.col("priority") == p).alias(p) for p in exprs.PRIORITIES],
                          F.array_sort(F.collect_set("algorithm")).alias("algorithms"), F.array_sort(F.collect_set("scanner")).alias("scanners")).first()
    severities = {r.severity: r.n for r in rollup.tally(enriched, "severity").orderBy("severity").collect()}
    first = enriched.where("recommend <> ''").groupBy("recommend").agg(F.min("ord").alias("first")).orderBy("first").collect()
    return {"bomFormat": "CBOM", "specVersion": "0.2", "target": target, "scannedAt": scanned_at,
            "summary": {"total": counts.total, "mock": counts.mock, "real": counts.total - counts.mock, "bySeverity": severities},
            "metadata": {"scanTarget": target, "findingCount": counts.total, "scannerSources": sorted(scanners) if scanners is not None else counts.scanners, "algorithmInventory": counts.algorithms},
            "riskSummary": {"moscaExposed": counts.exposed, "priorities": {p: counts[p] for p in exprs.PRIORITIES}}, "recommendations": [r.recommend for r in first],
            "mockWarning": "CONTAINS MOCK FINDINGS" if counts.mock else None}


def write_cbom(enriched: DataFrame, path: str, target: str, scanned_at: str, scanners: list[str] | None = None) -> DataFrame:
    """The bill of materials of a scan: aggregates in the header; components as the body; inventory and migration items as the footer, one a family."""
    head = json.dumps(cbom_header(enriched, target, scanned_at, scanners))
    inventory = [r.json for r in rollup.inventory(enriched).select(F.to_json(F.struct("*")).alias("json"), "family").orderBy("family").collect()]
    work = [r.json for r in rollup.work_items(enriched).select(F.to_json(F.struct("*")).alias("json"), "family").orderBy("family").collect()]
    tail = f'], "intelligence": {{"inventory": [{",".join(inventory)}]}}, "migration": {{"workItems": [{",".join(work)}]}}}}'
    body = F.to_json(F.struct(*[c for c in enriched.columns if c != "ord"]))
    return write(enriched, ["ord"], path, head[:-1] + ', "components": [', tail, body=body, packed=True)
