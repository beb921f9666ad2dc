"""Scans of literal inputs against stated rows."""

import literal_inputs
import pytest
from literal_rows import EXPECTED
from pyspark.sql import functions as F

from siltstone.operators import detect, rollup
from siltstone.plans import scan as whole
from siltstone.sources import files, manifests, x509


def line_findings(spark):
    rows = spark.createDataFrame([("app/x.py", i, s) for i, s in enumerate(literal_inputs.LINES, 1)], "key string, line int, content string")
    return detect.line_findings(rows).select("line", "algorithm", "category", "key_size", "mode", "protocol_version", "library", "usage", "evidence")


def cloud_hsm_findings(spark):
    rows = spark.createDataFrame([("app/x.tf", i, s) for i, s in enumerate(literal_inputs.LINES, 1)], "key string, line int, content string")
    return detect.cloud_findings(rows).unionByName(detect.hsm_findings(rows)).select("scanner", "line", "algorithm", "category", "library", "confidence", "evidence")


def package_findings(spark):
    return detect.package_findings(manifests.declared_packages(literal_inputs.table(spark, literal_inputs.MANIFESTS)))


def binary_findings(spark):
    return detect.binary_findings(files.binary_strings(literal_inputs.binaries(spark))).select("file_path", "place", "algorithm", "category", "key_size", "usage", "evidence")


def archive_members(spark):
    found = files.archive_members(literal_inputs.archives(spark))
    return found.select("path", F.regexp_replace("member", "^[^>]*>", "").alias("member"), F.length("content").cast("long").alias("n_bytes"))


def archive_findings(spark):
    found = whole.container_findings(literal_inputs.archives(spark))
    return found.select("file_path", "line", "algorithm", "category", "usage", "evidence")


def scan(spark):
    found = whole.scan_files(literal_inputs.tree(spark))
    return found.select("scanner", "file_path", "line", "algorithm", "category", "key_size", "severity", "priority")


def scan_counts(spark):
    return rollup.tally(whole.scan_files(literal_inputs.tree(spark)), "scanner", "family")


def locked_packages(spark):
    return manifests.declared_packages(literal_inputs.table(spark, literal_inputs.LOCKS))


def locked_findings(spark):
    return detect.package_findings(manifests.declared_packages(literal_inputs.table(spark, literal_inputs.LOCKS))).select("file_path", "algorithm", "library", "confidence", "version")


def certificates(spark):
    return x509.certificates(literal_inputs.table(spark, {"c.pem": literal_inputs.CERTIFICATE, "n.pem": "-----BEGIN CERTIFICATE-----x", "t.txt": "text"}))


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_rows(spark, name):
    columns, rows = EXPECTED[name]
    got = globals()[name](spark).select(*columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, rows))
