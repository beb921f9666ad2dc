"""An interchange document travels as columns and lies packed; places of its rows are read off where they stand, without a sort."""

import json

from pyspark.sql import functions as F

from siltstone.operators import score
from siltstone.plans import documents
from siltstone.sources.shared import Folder


def test_results_lie_packed_and_are_placed_where_they_stand(spark, tmp_path):
    rows = [(k * 3, "source", f"f{k % 9}", k, "RSA", "asymmetric", None, "", "", "", "direct", 0.9) for k in range(500)]
    e = score.enrich(spark.createDataFrame(rows, "ord long, scanner string, file_path string, line int, algorithm string, category string, key_size int, curve string, mode string, library string, usage string, confidence double"))
    at = str(tmp_path / "s")
    documents.write_sarif(e.repartition(5, "file_path"), at, properties=("ord",))
    parts = [n for n in Folder(spark, at).names("body") if n.startswith("part-")]
    assert len(parts) > 1 and all(n.endswith(".gz") for n in parts)
    results = json.loads(documents.text(spark, at))["runs"][0]["results"]
    assert [r["properties"]["ord"] for r in results] == [3 * k for k in range(500)]
    placed = documents.placed_lines(spark, at, "properties struct<ord bigint>")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "RebalancePartitions" not in plan
    assert sorted((r.place, r.r.properties.ord) for r in placed.collect()) == [(k + 1, 3 * k) for k in range(500)]


def test_places_of_a_file_read_in_blocks(spark, tmp_path):
    documents.write(spark.range(900).select("id", F.to_json(F.struct("id")).alias("json")), ["id"], str(tmp_path / "d"), "[", "]", 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
        got = documents.placed_lines(spark, str(tmp_path / "d"), "id bigint").select("place", "r.id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == [(k + 1, k) for k in range(900)]
