"""Facts of a code base are kept by kind; what several parts of the structure need is worked out once."""

from pyspark.sql import functions as F

from siltstone.operators import code, structure
from siltstone.sources.shared import kept


def test_kept_by_a_column_reads_only_what_is_asked_for(spark):
    rows = spark.range(40).select(F.format_string("p%d", "id").alias("path"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("kind"), F.col("id").alias("n"))
    got = kept(rows, "rows", by="kind")
    assert got.schema.simpleString() == rows.schema.simpleString() and sorted(got.collect()) == sorted(rows.collect())
    plan = got.where("kind in ('a', 'c')")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [kind" in plan
    assert {f.split("kind=")[1][0] for f in got.inputFiles()} == set("abcd")


def test_imports_of_the_structure_are_worked_out_once(spark):
    texts = spark.createDataFrame([("a/x.py", "from a.y import f\nf()\n"), ("a/y.py", "def f():\n    pass\n"), ("tests/test_x.py", "import a.x\n")], "path string, text string")
    plain, named = structure.parts(texts, kept(code.python_facts(texts), "facts", by="kind"))
    for made in (plain, named.backed):
        assert "posexplode" not in made._jdf.queryExecution().optimizedPlan().toString()  # candidates of an import
    assert {(r.source, r.target) for r in plain.where("relation = 'IMPORTS'").collect()} == {("file:a/x.py", "file:a/y.py"), ("file:tests/test_x.py", "file:a/x.py")}


def test_what_caps_leave_out_needs_no_sort(spark):
    nodes = spark.range(9).select(F.concat(F.lit("file:"), "id").alias("id"), F.lit("FILE").alias("type"))
    edges = spark.range(81).select(F.concat(F.lit("file:"), F.floor(F.col("id") / 9)).alias("source"), F.lit("CALLS").alias("relation"), F.concat(F.lit("file:"), F.col("id") % 9).alias("target"))
    for caps, want in (((4, 10), (5, 6)), ((4, 99), (5, 0)), ((None, None), (0, 0)), ((99, 80), (0, 1))):
        left_out = structure.component_graph(nodes, edges, *caps)[2]
        assert tuple(left_out.first()) == want
        assert "Sort [" not in left_out._jdf.queryExecution().optimizedPlan().toString()
