"""Table sources: text lines of driver tables, and a view of synthetic findings that exercises the relational operators.

The synthetic view is integer arithmetic on lineitem. It is not security data.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many tasks as the cluster has cores, if the scan has fewer: a small table is one row group, so one task. A scan of
    enough parts stays as it is, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def fixed(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A table of a few fixed rows of strings, numbers and arrays, made where it is used. createDataFrame of a list would send it through Python workers,
    of which an executor keeps as many more as it has cores."""
    names = [f.split()[0] for f in fields.split(", ")]
    held = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(held), f"array<struct<{fields}>>")))


def lines(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, line, content): one row per line, numbered from 1; split at every line break that str.splitlines knows."""
    cut = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]", -1)
    whole = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return df.select(key.alias("key"), F.posexplode(whole).alias("at", "content")).select("key", (F.col("at") + 1).alias("line"), "content")


ALGORITHMS = ["RSA", "ECDSA", "ECDH", "DH", "DSA", "ECC", "AES-128", "AES-256", "DES", "3DES", "RC4", "ChaCha20", "MD5", "SHA-1", "SHA-256", "SHA-384",
              "HMAC", "PBKDF2", "TLS1.0", "TLS1.2", "PEM-CERTIFICATE", "KEYSIZE", "OpenSSL", "KMS"]
SCANNERS = ["runtime", "source", "binary", "container", "dependency", "hsm", "cloud"]
USAGES = ["runtime observation", "direct", "binary string reference", "container file reference", "dependency reference", "hsm integration reference", "cloud crypto configuration"]


def synthetic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, okey and the columns of a finding, one per line item."""
    t = load(spark, sf_dir, "lineitem")
    kind, scanner = F.col("l_partkey") % 24, (F.col("l_linenumber") % 7).cast("int")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    return t.select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 20_000_000 + F.col("l_partkey")) * 64 + F.col("l_quantity").cast("int") % 64).cast("long").alias("ord"),
        F.col("l_orderkey").alias("okey"),
        pick(SCANNERS, scanner).alias("scanner"),
        F.concat(F.when(F.col("l_suppkey") % 5 == 0, "a-b").otherwise("a"), F.lit("/m"), (F.col("l_suppkey") % 10).cast("string"), F.lit("/f"), (F.col("l_partkey") % 48).cast("string"), F.lit(".py")).alias("file_path"),
        (F.col("l_quantity").cast("int") % 20).alias("line"),
        pick(ALGORITHMS, kind).alias("algorithm"),
        F.when(kind < 6, "asymmetric").when(kind < 12, "symmetric").when(kind < 18, "hash").when(kind < 20, "protocol").when(kind == 20, "certificate").when(kind == 22, "library").otherwise("key").alias("category"),
        F.when(kind == 0, F.when(F.col("l_orderkey") % 5 < 4, F.element_at(F.array(F.lit(1024), F.lit(2048), F.lit(3072), F.lit(4096)), (F.col("l_orderkey") % 5 % 4 + 1).cast("int")))).when(kind == 6, 128).when(kind == 7, 256).alias("key_size"),
        F.lit("").alias("curve"),
        F.when(F.col("l_orderkey") % 3 == 0, "CBC").otherwise("").alias("mode"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("lib"), (F.col("l_suppkey") % 9).cast("string"))).otherwise("").alias("library"),
        pick(USAGES, scanner).alias("usage"),
        F.when(F.col("l_orderkey") % 3 == 0, 0.5).when(F.col("l_orderkey") % 3 == 1, 0.7).otherwise(0.9).cast("double").alias("confidence"),
    )
