"""Worked values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import exprs
from siltstone.operators import score

WORKED = [("RSA", 2048, 70, "P1", "critical"), ("RSA", 1024, 100, "P0", "critical"), ("ECDSA", None, 70, "P1", "critical"), ("DES", None, 95, "P0", "high"), ("MD5", None, 95, "P0", "high"),
          ("TLS1.0", None, 45, "P2", "medium"), ("TLS1.2", None, 25, "P3", "medium"), ("AES-256", 256, 0, "P3", "low"), ("SHA-256", None, 0, "P3", "low"), ("SHA-384", None, 25, "P3", "medium"),
          ("OpenSSL", None, 25, "P3", "medium"), ("KEYSIZE", None, 25, "P3", "medium"), ("PBKDF2", None, 25, "P3", "medium")]


def test_worked_scores(spark):
    rows = spark.createDataFrame([(n, k) for n, k, *_ in WORKED], "algorithm string, key_size int")
    got = {(r.algorithm, r.key_size): (r.priority_score, r.priority, r.severity) for r in score.assess(rows).collect()}
    assert got == {(n, k): tuple(x) for n, k, *x in WORKED}


def test_factors_and_horizon(spark):
    rows = spark.createDataFrame([("RSA", 1024), ("AES", None)], "algorithm string, key_size int")
    got = {r.algorithm: r for r in score.assess(rows, (1, 1, 10)).collect()}
    assert got["RSA"].risk_factors == ["quantum-vulnerable public-key cryptography", "RSA key below 2048 bits"] and got["AES"].risk_factors == ["inventory and review"]


@pytest.mark.parametrize(("name", "family", "shown"), [("SHA-384", "SHA-2", "SHA"), ("sha-256", "SHA-2", "SHA"), ("TLS1.2", "TLS", "TLS/SSL"), ("HMAC-X", "HMAC", "HMAC"), ("PBKDF2", "KDF", "PBKDF2"), ("PEM-KEY", "PEM", "PEM-KEY")])
def test_families(spark, name, family, shown):
    r = spark.range(1).select(exprs.family(F.lit(name)).alias("f"), exprs.display_family(F.lit(name)).alias("d")).first()
    assert (r.f, r.d) == (family, shown)


@pytest.mark.parametrize(("line", "out"), [("  token = 'abc'  ", "token=[REDACTED]"), ("api_key: x, y", "api_key:[REDACTED], y"), ("-----BEGIN PRIVATE KEY-----abc", "[REDACTED PRIVATE KEY MATERIAL]"), ("a" * 200, "a" * 160)])
def test_redaction(spark, line, out):
    assert spark.createDataFrame([(line,)], "l string").select(exprs.redacted(F.col("l")).alias("r")).first().r == out


def test_ids_print_none(spark):
    import hashlib

    row = spark.createDataFrame([("source", "a/b.py", 3, "RSA", "asymmetric", None, "", "direct")], "scanner string, file_path string, line int, algorithm string, category string, key_size int, curve string, usage string")
    assert row.select(exprs.finding_id().alias("i")).first().i == hashlib.sha1(b"source|a/b.py|3|RSA|asymmetric|None||direct").hexdigest()[:12]
