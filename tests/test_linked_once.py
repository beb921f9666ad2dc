"""Edges of findings come from rows that differ in their links; what decides about links comes from all rows."""

from pyspark.sql import functions as F

from siltstone.operators import graph, relate, score
from siltstone.sources.tables import synthetic_findings


def test_usage_graph_of_repeated_findings(spark):
    e = score.enrich(synthetic_findings(spark, "/root/testdata/sf0.001"))
    many = e.unionByName(e.withColumn("ord", F.col("ord") + 1)).cache()  # an id twice among the first static rows of a family
    got = {tuple(r) for r in graph.usage_graph(many).collect()}
    assert got == {tuple(r) for r in graph.usage_edges(many, relate.related(many)).collect()}
    once = relate.linked_once(many)
    assert once.count() <= e.count() and relate.first_static(many).groupBy("family", "id").count().where("count > 1").count() > 0
    assert graph.usage_graph(many).count() < graph.usage_edge_rows(many, relate.related(many)).count()
