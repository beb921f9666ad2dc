"""A bill of materials travels as columns and lies packed; it reads as before."""

import json

from pyspark.sql import functions as F

from siltstone.operators import score
from siltstone.plans import documents
from siltstone.sources.shared import Folder


def test_packed_body_holds_every_component_once_in_order(spark, tmp_path):
    rows = [(k, "source", f"f{k % 9}", k, "RSA", "asymmetric", None, "", "", "", "direct", 0.9) for k in range(400)]
    e = score.enrich(spark.createDataFrame(rows, "ord long, scanner string, file_path string, line int, algorithm string, category string, key_size int, curve string, mode string, library string, usage string, confidence double"))
    e = e.unionByName(e.where("ord in (0, 7)").withColumn("file_path", F.lit("again")))  # two of one order, the least among them
    index = documents.write_cbom(e.repartition(5), str(tmp_path / "b"), "t", "now")
    names = Folder(spark, str(tmp_path / "b")).names("body")
    parts = [n for n in names if n.startswith("part-")]
    assert parts and all(n.endswith(".gz") for n in parts)
    whole = json.loads(documents.text(spark, str(tmp_path / "b")))
    assert [c["line"] for c in whole["components"]] == sorted([*range(400), 0, 7]) and len(whole["components"][0]) == len([c for c in e.columns if c not in ("ord", "key_size")])
    assert documents.lines(spark, str(tmp_path / "b")).count() == 402
    assert sum(r.bytes for r in index.collect()) < len(json.dumps(whole)) / 3
