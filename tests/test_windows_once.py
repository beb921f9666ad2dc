"""Lines are normalised once for windows of all widths."""

from siltstone.operators import duplication


def test_one_pass_over_the_text(spark):
    texts = spark.createDataFrame([("p", "\n".join(f"a{k}" for k in range(13))), ("q", "x"), ("r", None)], "path string, text string")
    found = duplication.windows(texts)
    assert {(r.path, r.start, r.width) for r in found.collect()} == {("p", s, w) for w in (12, 8, 6) for s in range(1, 15 - w)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
