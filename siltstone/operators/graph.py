"""Property graphs of findings and code as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import exprs
from siltstone.operators import relate

#: Nodes and edges of a component graph that is shown. Fixed values; options of structure.component_graph.
MAX_NODES, MAX_EDGES = 800, 3000


def edge(source: F.Column, target: F.Column, relation: str) -> list[F.Column]:
    return [source.alias("source"), target.alias("target"), F.lit(relation).alias("relation")]


def usage_edge_rows(enriched: DataFrame, related: DataFrame) -> DataFrame:
    """(source, target, relation): artifact contains finding, finding is an instance of its family, uses its library, and relations; an edge may be there
    more than once."""
    parts = [
        enriched.select(*edge(F.concat(F.lit("artifact:"), "file_path"), F.col("id"), "contains")),
        enriched.select(*edge(F.col("id"), F.concat(F.lit("family:"), "family"), "instance-of")),
        enriched.where("library <> ''").select(*edge(F.col("id"), F.concat(F.lit("library:"), "library"), "uses")),
        related.select(F.col("id").alias("source"), "target", "relation"),
    ]
    return reduce(DataFrame.unionByName, parts)


def usage_edges(enriched: DataFrame, related: DataFrame) -> DataFrame:
    """The same, each edge once."""
    return usage_edge_rows(enriched, related).distinct()


def usage_graph(enriched: DataFrame) -> DataFrame:
    """The edges of findings and of their relations, each at least once: rows that have the same edges are one before anything is joined."""
    once = relate.linked_once(enriched)
    return usage_edge_rows(once, relate.related(once, relate.first_static(enriched)))


def usage_nodes(enriched: DataFrame) -> DataFrame:
    """(node, type)."""
    parts = [enriched.select(c.alias("node"), F.lit(t).alias("type")) for c, t in (
        (F.concat(F.lit("artifact:"), "file_path"), "artifact"), (F.col("id"), "finding"), (F.concat(F.lit("family:"), "family"), "family"),
        (F.when(F.col("library") != "", F.concat(F.lit("library:"), "library")), "library"))]
    return reduce(DataFrame.unionByName, parts).where("node is not null").distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): each end of an edge counts; combined before the shuffle."""
    return edges.select("source").union(edges.select("target")).toDF("node").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def edge_id(source: F.Column, relation: F.Column, target: F.Column) -> F.Column:
    return exprs.digest("r", 11, source, relation, target, bits=2)


def directories(paths: DataFrame) -> DataFrame:
    """(parent, child): chain of folders above each path."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
    at = paths.select(F.posexplode(steps).alias("k", "child"))
    return at.select(F.when(F.col("k") > 0, F.regexp_replace("child", "/[^/]*$", "")).otherwise("").alias("parent"), "child").distinct()


def blast_radius(edges: DataFrame, start: str) -> DataFrame:
    """(node, bucket): what one hop from a node reaches, each node in its first bucket."""
    hop = F.when(F.col("source") == start, F.col("target")).otherwise(F.col("source"))
    near = edges.where((F.col("source") == start) | (F.col("target") == start)).select(hop.alias("node"), "relation", (F.col("source") == start).alias("out"))
    order = ["contains", "same-artifact", "uses", "instance-of", "same-library", "runtime-observed", "same-family"]
    near = near.where(F.col("node") != start)
    return near.groupBy("node").agg(F.min_by("relation", F.struct(exprs.rank(F.col("relation"), order, 99).alias("r"), F.col("relation").alias("n"))).alias("bucket"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n): repeated ids, edges without an end. Edges may be repeated; they are worked out once for both of their ends."""
    twice = nodes.groupBy("node").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate").alias("problem"), "n")
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    lost = ends.join(nodes, "node", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dangling").alias("problem"), "n")
    return twice.union(lost)
