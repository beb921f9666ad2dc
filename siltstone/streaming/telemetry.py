"""Runtime telemetry lines. Parsing is row by row, so that it runs alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Beginning of a telemetry line, fields that it must have, most observations of a scan. Fixed values.
MARK, REQUIRED, MOST = "^[A-Z]+-TELEMETRY ", ["lib", "algo", "op"], 50
#: Categories by operation; else by the beginning of the name. Fixed values.
OPERATIONS = {"hash": ["digest", "mac", "kdf"], "key": ["random"], "protocol": ["context", "handshake"]}
NAMES = [("asymmetric", ["RSA", "ECDSA", "ECDH", "ECC", "DSA", "DH", "ML-", "ED"]), ("symmetric", ["AES", "CHACHA", "DES", "RC4"]),
         ("hash", ["SHA", "MD5", "HMAC", "BLAKE", "KDF", "HKDF", "PBKDF"]), ("protocol", ["TLS", "SSL"])]


def first_observations(parsed: DataFrame, order: list, most: int | None = MOST) -> DataFrame:
    """The first observations of a scan; None: all."""
    return parsed if most is None else parsed.orderBy(*order).limit(most)


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds lib, algo, op of `key=value` fields; the last of a repeated key counts; lines that lack one are left out."""
    pairs = F.filter(F.split(F.regexp_replace(value, MARK, ""), r"\s+"), lambda p: p.contains("="))

    def field(name: str):
        mine = F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == name)
        return F.regexp_extract(F.try_element_at(mine, F.lit(-1)), "(?s)^[^=]*=(.*)$", 1)

    out = lines.where(F.col(value).rlike(MARK))
    for name in REQUIRED:
        out = out.withColumn(name, field(name))
    return out.where(" and ".join(f"{name} <> ''" for name in REQUIRED))


def category(algorithm, operation):
    """Category of an observation: by certain operations first, then by the beginning of the algorithm's name."""
    name = F.upper(algorithm)
    begins = lambda beginnings: name.rlike("^(" + "|".join(beginnings) + ")")
    by_operation = [F.when(operation.isin(names), kind) for kind, names in OPERATIONS.items()]
    return F.coalesce(*by_operation, *[F.when(begins(names), kind) for kind, names in NAMES], F.lit("unknown"))


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of text files as they arrive."""
    return parse(spark.readStream.text(folder))
