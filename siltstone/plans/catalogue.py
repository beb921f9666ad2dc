"""The registered queries of the reference's operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import exprs
from siltstone.operators import delta, detect, duplication, graph, notes, relate, rollup, score, search, validate
from siltstone.plans import report
from siltstone.sources.tables import lines, load, spread, synthetic_findings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def on_findings(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """A query on the enriched synthetic findings."""
    QUERIES[name] = lambda spark, d: f(score.enrich(synthetic_findings(spark, d)))


def _hits(df: DataFrame, key, text: str) -> DataFrame:
    found = detect.line_findings(lines(spread(df.select(key.alias("key"), text)), F.col("key"), F.col(text)))
    return found.select(F.col("file_path").alias("key"), "line", "algorithm", "category", "confidence", "evidence")


@query
def line_rule_hits(spark, d):
    return _hits(load(spark, d, "documents"), F.col("doc_id").cast("string"), "text")


@query
def line_rule_counts_by_lang(spark, d):
    none = F.lit("\0")  # a null language is a group like any other
    found = _hits(load(spark, d, "documents"), F.concat_ws("/", F.coalesce("lang", none), F.col("doc_id").cast("string")), "text")
    return found.groupBy(F.nullif(F.split_part("key", F.lit("/"), F.lit(1)), none).alias("lang"), "algorithm").agg(F.count(F.lit(1)).alias("n"))


@query
def page_rule_hits(spark, d):
    return _hits(load(spark, d, "pages"), F.col("page_id").cast("string"), "html")


@query
def conversation_rule_hits(spark, d):
    return _hits(load(spark, d, "conversations"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text")


@query
def redacted_evidence(spark, d):
    from siltstone.functions.rules import SECRET

    rows = lines(load(spark, d, "documents"), F.col("doc_id"), F.col("text")).where(F.col("content").rlike(f"(?iuU){SECRET}"))
    return rows.select(F.col("key").alias("doc_id"), "line", exprs.redacted(F.col("content")).alias("evidence"))


@query
def findings_dedupe(spark, d):
    return score.dedupe(synthetic_findings(spark, d)).select("ord", "scanner", "file_path", "line", "algorithm", "key_size", "mode", "library")


on_findings("findings_ids", lambda e: e.select("ord", "id", "fp"))
on_findings("assess_scores", lambda e: e.select("ord", "algorithm", "mosca_exposed", "severity", "priority_score", "priority"))
on_findings("risk_factor_tally", lambda e: e.select(F.explode("risk_factors").alias("factor")).groupBy("factor").agg(F.count(F.lit(1)).alias("n")))
on_findings("severity_tally", lambda e: rollup.tally(e, "severity"))
on_findings("priority_tally", lambda e: rollup.tally(e, "priority", "severity"))
on_findings("recommend_join", lambda e: e.select("ord", "algorithm", "recommend"))
on_findings("recommendation_cards", lambda e: e.groupBy("recommend").agg(F.count(F.lit(1)).alias("n"), rollup.worst("severity", exprs.SEVERITIES).alias("severity"), rollup.worst("priority", exprs.PRIORITIES).alias("priority")))
on_findings("inventory_by_family", rollup.inventory)
on_findings("inventory_artifacts", rollup.artifacts)
on_findings("display_families", rollup.display_families)
on_findings("correlate_supports", lambda e: relate.supports(e))
on_findings("related_links", lambda e: relate.related(e))
on_findings("related_counts_by_relation", lambda e: rollup.tally(relate.related(e), "relation"))
on_findings("evidence_strength_tally", lambda e: rollup.tally(e, "strength", "scanner"))
on_findings("migration_work_items", rollup.work_items)
on_findings("migration_roadmap", lambda e: rollup.roadmap(rollup.work_items(e)))
on_findings("migration_status_counts", lambda e: rollup.tally(e, "status"))
on_findings("knowledge_matches", relate.knowledge)
on_findings("knowledge_coverage", lambda e: relate.knowledge(e).groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("strength") == "HIGH").alias("high")))
on_findings("strategy_map", lambda e: rollup.tally(e.withColumn("strategy", exprs.strategy(F.col("algorithm"), F.col("category"), F.col("usage"))), "strategy", "algorithm", "category"))


def _results(e: DataFrame) -> DataFrame:
    """Validation results made up from findings."""
    state = F.element_at(F.array(*map(F.lit, ("CONFIRMED", "PARTIALLY_CONFIRMED", "OBSERVED", "NOT_APPLICABLE", "FAILED"))), (F.col("ord") % 5 + 1).cast("int"))
    own = e.where("ord % 11 = 0").select(F.col("id").alias("finding_id"), state.alias("v_status"), F.lit("tls").alias("validation_type"), F.col("algorithm").alias("observed_algorithm"))
    seen = e.where("scanner = 'runtime' and ord % 3 = 0 and algorithm in ('RSA', 'MD5', 'SHA-256')").select(F.lit(""), F.lit("OBSERVED"), F.lit("runtime"), "algorithm")
    return own.union(seen).union(e.where("okey = 0").select(F.lit(""), F.lit("OBSERVED"), F.lit("runtime"), F.lit("ML-KEM")))


on_findings("validation_rollup", lambda e: relate.validation_rollup(e, _results(e)))
on_findings("unrelated_observations", lambda e: rollup.tally(relate.unrelated_observations(e, _results(e)), "observed_algorithm"))


TOUCHED = ["a/m1/f1.py", "a/m3/f7.py", "a-b/m0/f4.py"]


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A scan before, under a shorter horizon, and one after, with some lines moved."""
    rows = synthetic_findings(spark, d)
    after = rows.where("okey % 10 <> 1").withColumn("line", F.when(F.col("okey") % 7 == 0, F.col("line") + 100).otherwise(F.col("line")))
    return score.enrich(rows.where("okey % 10 <> 0"), (1, 1, 10)), score.enrich(after)


@query
def delta_rows(spark, d):
    return delta.changes(*_scans(spark, d))


@query
def delta_summary(spark, d):
    found = delta.changes(*_scans(spark, d))
    return found.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.coalesce("before_severity", F.lit("")) == "critical") | (F.coalesce("after_severity", F.lit("")) == "critical")).alias("critical"))


@query
def severity_regressions(spark, d):
    return delta.regressions(delta.changes(*_scans(spark, d))).drop("change")


@query
def verify_status(spark, d):
    return delta.verification(*_scans(spark, d), TOUCHED)


@query
def verify_status_replaced(spark, d):
    before, after = _scans(spark, d)
    return delta.verification(before, after.join(before.select("id"), "id", "left_anti"))


@query
def set_difference(spark, d):
    before, after = _scans(spark, d)
    return before.select("id").subtract(after.select("id"))


@query
def set_intersection(spark, d):
    before, after = _scans(spark, d)
    return before.select("id").intersect(after.select("id"))


@query
def graph_diff(spark, d):
    one = lambda df: df.groupBy("id").agg(F.max_by("severity", "ord").alias("severity"))
    before, after = _scans(spark, d)
    return delta.graph_changes(one(before), one(after))


@query
def triage_overlay(spark, d):
    e = score.enrich(synthetic_findings(spark, d))
    states = F.array(*map(F.lit, ("open", "reviewed", "planned", "in_progress", "fixed", "resolved", "suppressed")))
    place = F.conv(F.substring("fp", 2, 4), 16, 10).cast("int") % 7
    recorded = e.where("scanner = 'hsm'").select("fp").distinct().select("fp", relate.migrated_triage(F.element_at(states, place + 1)).alias("triage"))
    return relate.triaged(e, recorded).select("ord", "fp", "triage")


@query
def triage_listing(spark, d):
    rows = load(spark, d, "events").where("event_type <> 'view'")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "user_id", "event_type")


on_findings("findings_filter_text", lambda e: score.matching(e, " LIB3 ", priority="P0").select("ord", "id", "file_path", "algorithm"))
on_findings("findings_report_order", lambda e: score.urgency_places(e).select("place", "ord", "priority_score", "file_path", "line", "algorithm"))
on_findings("top_findings", lambda e: score.top(e).select("id", "priority", "algorithm"))
on_findings("usage_graph_edges", lambda e: graph.usage_graph(e).distinct())
on_findings("usage_graph_nodes", graph.usage_nodes)
on_findings("graph_degree", lambda e: graph.degree(graph.usage_graph(e).distinct()))
on_findings("graph_health", lambda e: graph.health(graph.usage_nodes(e), graph.usage_graph(e)))
on_findings("blast_radius", lambda e: graph.blast_radius(graph.usage_graph(e).distinct(), "library:lib3"))
on_findings("path_directories", lambda e: graph.directories(e.select(F.col("file_path").alias("path")).distinct()))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


@query
def keyword_search(spark, d):
    return search.search(_notes(spark, d), "The tion", 20)


@query
def budgeted_context(spark, d):
    return search.context(_notes(spark, d), "The tion", n=20)


@query
def history_index(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("scans"), F.max("event_id").alias("latest"))


@query
def retention_newest_n(spark, d):
    return load(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "user_id")


@query
def previous_scan(spark, d):
    return load(spark, d, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query
def telemetry_parse(spark, d):
    from siltstone.streaming.telemetry import parse

    said = F.concat(F.lit("APP-TELEMETRY v=1 lib="), "event_type", F.lit(" algo="), F.get_json_object("props", "$.k"), F.lit(" op=use"))
    return parse(load(spark, d, "events").select("event_id", said.alias("value"))).select("event_id", "lib", "algo")


@query
def duplicate_windows_exact(spark, d):
    return duplication.windows(spread(_notes(spark, d)))


@query
def duplicate_windows_masked(spark, d):
    return duplication.windows(spread(_notes(spark, d)), True)


on_findings("sarif_rules", report.sarif_rules)
on_findings("sarif_results", report.sarif_results)
on_findings("cbom_summary", report.cbom_summary)


on_findings("gate_critical", lambda e: validate.gate(e, "critical"))
on_findings("gate_observed", lambda e: validate.gate(relate.validation_rollup(e, _results(e)), "observed"))
on_findings("findings_flagged", lambda e: validate.flagged(e, quantum=True, migration_ready=True).select("ord", "algorithm", "status"))
on_findings("inventory_cross_linked", lambda e: validate.cross_linked(rollup.inventory(e)).select("family", "findings", "runtime"))
on_findings("knowledge_by_direction", relate.direction_skills)
on_findings("cbom_document", report.cbom_json)


@query
def scan_counts(spark, d):
    e = score.enrich(synthetic_findings(spark, d)).withColumn("scan_id", (F.col("okey") % 4).cast("string"))
    return report.scan_counts(e, e.where("scanner = 'hsm' and okey % 4 < 3"))


@query
def relativized_findings(spark, d):
    e = score.enrich(synthetic_findings(spark, d).withColumn("file_path", F.when(F.col("okey") % 3 == 0, F.concat(F.lit("/w/"), "file_path")).when(F.col("okey") % 3 == 1, F.concat(F.lit("/else/"), "file_path")).otherwise(F.col("file_path"))))
    return report.relativized(e, "/w", "o/r@c").select("ord", "file_path", "id", "fp", "old_id")


@query
def relativized_links(spark, d):
    e = score.enrich(synthetic_findings(spark, d).where("okey < 40").withColumn("file_path", F.concat(F.lit("/w/"), "file_path")))
    return report.remapped(relate.supports(e).select("ord", "id", "support_id"), report.relativized(e, "/w", "o/r@c"), "id", "support_id")


on_findings("sarif_json", lambda e: report.sarif_json(e))


@query
def page_paths(spark, d):
    return load(spark, d, "pages").select("page_id", notes.short_path(F.split_part("url", F.lit("?"), F.lit(1))).alias("shown"))
