"""Fixed tables are made without Python workers; what a finding's skills are grouped by travels with it."""

from pyspark.sql import functions as F

from siltstone.functions import rules
from siltstone.operators import relate, remedy, score
from siltstone.sources.tables import fixed


def test_fixed_tables_hold_their_rows_and_need_no_python(spark):
    rows = [(1, "a \"b\"", ["x", "é"], None), (2, "", [], 0.5)]
    assert [tuple(r) for r in fixed(spark, rows, "k int, name string, some array<string>, x double").collect()] == rows
    skills = [(k, *s) for k, s in enumerate(rules.SKILLS)]
    some = "array<string>"
    assert [tuple(r) for r in fixed(spark, skills, f"k int, skill string, tier int, a {some}, s {some}, c {some}, u {some}").collect()] == [tuple(list(x) if isinstance(x, tuple) else x for x in s) for s in skills]
    found = spark.range(3).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("p.py").alias("path"), F.lit("n").alias("name"), F.lit("DEAD_CODE").alias("category"), F.lit("LOW").alias("confidence"))
    assert "ExistingRDD" not in remedy.options(found)._jdf.queryExecution().executedPlan().toString()


def test_skills_of_a_direction_need_no_join_of_findings_with_themselves(spark):
    rows = [(k, "source", f"f{k}", k, a, c, None, "", "", "", "direct", 0.9) for k, (a, c) in enumerate([("RSA", "asymmetric"), ("MD5", "hash"), ("AES-128", "symmetric"), ("RSA", "asymmetric")])]
    e = score.enrich(spark.createDataFrame(rows, "ord long, scanner string, file_path string, line int, algorithm string, category string, key_size int, curve string, mode string, library string, usage string, confidence double"))
    got = relate.direction_skills(e)
    want: dict = {}
    for r in sorted(relate.knowledge(e).join(e.select("ord", "recommend"), "ord").collect(), key=lambda r: (r.ord, r.place)):
        want.setdefault(r.recommend, dict()).setdefault(r.skill)
    assert {r.direction: r.skills for r in got.collect()} == {k: ",".join(v) for k, v in want.items()} and len(want) > 1
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate(keys=[recommend" in plan.replace("ObjectHashAggregate", "")
