"""Validation of findings against what was observed: which validator fits, matches with handshakes and runs, address policy, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import exprs, rules

#: Protocol names as findings have them, and as handshakes report them. Fixed values.
PROTOCOLS = {"TLS": "TLS", "SSL": "SSL", "TLS10": "TLSv1", "TLS11": "TLSv1.1", "TLS12": "TLSv1.2", "TLS13": "TLSv1.3"}
#: Outcomes that a gate counts. Fixed values.
GATES = {"confirmed": ["RUNTIME_CONFIRMED"], "observed": ["RUNTIME_CONFIRMED", "RUNTIME_OBSERVED", "RUNTIME_CORRELATED"]}
RESULT = ["finding_id", "target", "validation_type", "v_status", "confidence", "note", "observed_algorithm", "correlation_status"]
NO_TLS, LINKED, UNSEEN = "plain-http target carries no TLS to observe", "same-family runtime observation linked", "probe ran; no same-family observation in this run"


def strategy_reason(name: Column, category: Column, usage: Column, is_mock: Column | None = None) -> Column:
    """struct(validator, reason): the validator that fits a finding (none for mocks), and why."""
    base = exprs.base_algorithm(name)
    found = exprs.strategy(name, category, usage)
    mock = F.lit(False) if is_mock is None else F.coalesce(is_mock, F.lit(False))
    said = lambda text: F.concat(base, F.lit(" "), category, F.lit(f" evidence maps to {text}"))
    reason = (F.when(mock, "mock findings are never actively validated").when(usage == "dependency integrity metadata", "lockfile integrity metadata is not runtime-probed")
              .when(found == "tls", said("TLS/certificate observation")).when((found == "runtime") & (category == "dependency"), "dependency reference maps to runtime library-usage observation")
              .when(found == "runtime", said("runtime crypto observation"))
              .otherwise(F.concat(F.lit("no automatic validator for "), F.when(base == "", "unknown").otherwise(base), F.lit(" "), F.when(category == "", "unclassified").otherwise(category), F.lit(" evidence"))))
    return F.struct(F.when(mock, "none").otherwise(found).alias("validator"), reason.alias("reason"))


def tls_match(name: Column, key_size: Column, version: Column, signature: Column, key: Column, size: Column) -> Column:
    """struct(v_status, confidence, note): a finding's claim beside a handshake (version, signature, key algorithm, key size).

    A protocol is confirmed by its version only; a key by its family, and wholly only if the sizes agree as well.
    """
    base, blank = exprs.base_algorithm(F.coalesce(name, F.lit(""))), lambda c: F.coalesce(c, F.lit(""))
    version, signature, seen = blank(version), blank(signature), exprs.family(blank(key))
    claimed = F.coalesce(*[F.when(base == k, v) for k, v in PROTOCOLS.items()])
    shown = lambda c: F.when(c == "", "unknown").otherwise(c)
    outcome = lambda status, confidence, *note: F.struct(F.lit(status).alias("v_status"), F.lit(confidence).alias("confidence"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in note]).alias("note"))
    same_version = (claimed == version) | (claimed == base) | version.startswith(claimed)
    same_family = (seen != "") & (seen == exprs.family(base))
    return (F.when(claimed.isNotNull() & same_version, outcome("CONFIRMED", 0.85, "observed ", version, " matches static claim ", base))
            .when(claimed.isNotNull(), outcome("NOT_CONFIRMED", 0.7, "observed ", shown(version), "; static claim ", base, " not observed in this handshake"))
            .when(same_family & F.coalesce(key_size == size, F.lit(False)), outcome("CONFIRMED", 0.8, "same family ", seen, " and key size ", size.cast("string"), " observed"))
            .when(same_family, outcome("PARTIALLY_CONFIRMED", 0.65, "same family ", seen, " observed (sig ", shown(signature), "); key-size match ", F.when(key_size.isNull(), "not checked").otherwise("differs")))
            .otherwise(outcome("NOT_CONFIRMED", 0.6, "observed ", shown(seen), " vs static claim ", shown(base))))


def runtime_results(findings: DataFrame, observations: DataFrame) -> DataFrame:
    """Findings that a run can validate (id, algorithm, category, usage), each with the first observation (ord, target, observed_algorithm)
    of its family. Observations are cut to one a family before the join."""
    fits = findings.where(exprs.strategy(F.col("algorithm"), F.col("category"), F.col("usage")) == "runtime").select("id", exprs.family(F.col("algorithm")).alias("family"))
    first = observations.withColumn("family", exprs.family(F.coalesce("observed_algorithm", F.lit("")))).groupBy("family").agg(F.min_by(F.struct("target", "observed_algorithm"), "ord").alias("o"))
    seen = F.col("o").isNotNull()
    return fits.join(first, "family", "left").select(
        F.col("id").alias("finding_id"), F.coalesce("o.target", F.lit("runtime probe (bundled fixture)")).alias("target"), F.lit("runtime").alias("validation_type"),
        F.when(seen, "CONFIRMED").otherwise("NOT_CONFIRMED").alias("v_status"), F.when(seen, 0.7).otherwise(0.6).alias("confidence"), F.when(seen, LINKED).otherwise(UNSEEN).alias("note"),
        F.coalesce("o.observed_algorithm", F.lit("")).alias("observed_algorithm"), F.when(seen, "RUNTIME_CONFIRMED").otherwise("STATIC_ONLY").alias("correlation_status"))


def tls_results(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Results of handshakes with targets (url, finding_ids, tls_version, signature_algorithm, public_key_algorithm, tls_key_size, error).

    A target with an allow-list meets the findings in it, by an equi-join on the exploded list; one without meets all findings that
    a handshake fits. Targets are probed addresses, a few dozen; the broadcast is left to their measured size. A target that meets none is
    an observation of its own.
    """
    fits = findings.where(exprs.strategy(F.col("algorithm"), F.col("category"), F.col("usage")) == "tls").select("id", "algorithm", "key_size")
    given = F.size(F.coalesce("finding_ids", F.array().cast("array<string>"))) > 0
    listed = targets.where(given).withColumn("id", F.explode(F.array_distinct("finding_ids"))).join(fits, "id")
    free = targets.where(~given).join(fits)
    columns = [*targets.columns, "id", "algorithm", "key_size"]
    met = listed.select(*columns).unionByName(free.select(*columns))
    https, failed = F.col("url").rlike("(?i)^https://"), F.col("error").isNotNull()
    match = tls_match(*map(F.col, ("algorithm", "key_size", "tls_version", "signature_algorithm", "public_key_algorithm", "tls_key_size")))
    rows = met.withColumn("m", F.when(https & ~failed, match))
    status = F.when(~https, "NOT_APPLICABLE").when(failed, "ERROR").otherwise(F.col("m.v_status"))
    seen = F.when(https & ~failed, F.coalesce("public_key_algorithm", F.lit(""))).otherwise("")
    correlation = F.when(status == "CONFIRMED", "RUNTIME_CONFIRMED").when(status == "PARTIALLY_CONFIRMED", "RUNTIME_CORRELATED").otherwise("STATIC_ONLY")
    out = rows.select(F.col("id").alias("finding_id"), F.substring("url", 1, 512).alias("target"), F.lit("tls").alias("validation_type"), status.alias("v_status"),
                      F.when(~https, 1.0).when(failed, 0.5).otherwise(F.col("m.confidence")).alias("confidence"),
                      F.when(~https, NO_TLS).when(failed, F.concat(F.lit("tls probe failed: "), "error")).otherwise(F.col("m.note")).alias("note"), seen.alias("observed_algorithm"), correlation.alias("correlation_status"))
    alone = targets.where(https & ~failed).join(met.select("url").distinct(), "url", "left_anti")
    alone = alone.select(F.lit("").alias("finding_id"), F.substring("url", 1, 512).alias("target"), F.lit("tls").alias("validation_type"), F.lit("OBSERVED").alias("v_status"), F.lit(0.8).alias("confidence"),
                         F.lit("").alias("note"), F.coalesce("public_key_algorithm", F.lit("")).alias("observed_algorithm"), F.lit("RUNTIME_OBSERVED").alias("correlation_status"))
    return out.unionByName(alone).select(*RESULT)


def run_summary(results: DataFrame) -> DataFrame:
    """(v_status, n) of a run."""
    return results.groupBy("v_status").agg(F.count(F.lit(1)).alias("n"))


def address_fault(url: Column, allowed: list[str] | None = None, any_host: bool = False) -> Column:
    """Why an address may not be probed; null if it may. Credentials are never echoed."""
    text = F.coalesce(url, F.lit(""))
    authority = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host_port = F.regexp_replace(authority, "^.*@", "")
    host = F.regexp_replace(F.lower(F.when(host_port.startswith("["), F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(host_port, "^([^:]*)", 1))), r"\.+$", "")
    port = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    number = port.try_cast("int")
    bad_port = (port != "") & (~port.rlike("^[0-9]+$") | F.coalesce(number > 65535, F.lit(True)))
    loopback = (host == "localhost") | (host == "::1") | host.rlike(r"^127(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    known = F.lit(any_host) | loopback | host.isin([h.lower() for h in allowed or []])
    return (F.when((text == "") | (F.length(text) > 2048), "URL must be a non-empty string under 2048 chars").when(text.rlike(r"[\x00-\x1f\x7f]"), "URL contains control characters")
            .when(~scheme.isin("http", "https"), "only http/https URLs may be probed").when(authority.rlike("^(?=[^@]*[^@:])[^@]*@"), "URLs with credentials are never probed")
            .when((host == "") | text.contains("\\") | text.contains(" "), "URL host is missing or malformed").when(bad_port, "URL port is invalid").when((port != "") & (number < 1), "URL port out of range")
            .when(~known, F.concat(F.lit("host '"), host, F.lit("' is not loopback; allowlist it or acknowledge non-loopback probing explicitly"))))


def gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """(failing, n): whether a threshold (confirmed, observed, critical) is met, and by how many findings."""
    if fail_on not in (*GATES, "critical"):
        raise ValueError(f"no such threshold: {fail_on}")
    hit = F.col("severity") == "critical" if fail_on == "critical" else F.col("validation_status").isin(GATES[fail_on])
    return findings.agg(F.count_if(hit).alias("n")).select((F.col("n") > 0).alias("failing"), "n")


def flagged(findings: DataFrame, *, quantum: bool = False, validated: bool = False, migration_ready: bool = False) -> DataFrame:
    """Only findings of quantum-vulnerable families, with a runtime validation, or that must migrate, as asked."""
    if quantum:
        findings = findings.where(exprs.family(F.col("algorithm")).isin(rules.QUANTUM_VULNERABLE))
    if validated:
        findings = findings.where(F.coalesce("validation_status", F.lit("STATIC_ONLY")).startswith("RUNTIME_"))
    return findings.where(F.col("status") == "MIGRATION_REQUIRED") if migration_ready else findings


def cross_linked(inventory: DataFrame) -> DataFrame:
    """Families of several findings, or seen at run time."""
    return inventory.where((F.col("findings") > 1) | F.col("runtime"))
