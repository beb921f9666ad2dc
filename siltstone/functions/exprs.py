"""Scalar functions on findings, as Column expressions inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import rules

#: Orders of decreasing urgency. Fixed values.
SEVERITIES = ["critical", "high", "medium", "low"]
PRIORITIES = ["P0", "P1", "P2", "P3"]
STATUSES = ["MIGRATION_REQUIRED", "MIGRATION_PLANNED", "MIGRATION_IN_PROGRESS", "MIGRATION_READY", "DISCOVERED", "ASSESSED"]
BUCKETS = ["Immediate", "Near-term", "Planned", "Monitor"]


def rank(value: Column, order: list[str], other: int) -> Column:
    """Place of a value in a list, from 0; `other` if it isn't there."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(other).cast("int")


def base_algorithm(name: Column) -> Column:
    n = F.upper(name)
    return (F.when(n.startswith("AES"), "AES").when(n.startswith("RSA"), "RSA").when(n.startswith("TLS"), F.replace(n, F.lit("."), F.lit("")))
            .when(n.startswith("SHA-2"), "SHA-2").when(n.startswith("PEM-"), "PEM").otherwise(n))


def family(name: Column) -> Column:
    """Coarser name, for grouping only."""
    base = base_algorithm(name)
    return (F.when(base.rlike("^SHA[-_ ]?(224|256|384|512)$"), "SHA-2").when(base.startswith("HMAC"), "HMAC")
            .when(base.isin("PBKDF2", "KDF"), "KDF").when(base.startswith("TLS"), "TLS").otherwise(base))


#: (beginnings, family) of the front end's own grouping, first match. Fixed values.
DISPLAY = [("AES", "AES"), ("RSA", "RSA"), ("ECDSA", "ECDSA"), ("ECDH", "ECDH"), ("EC_", "ECC"), ("DH", "DH"), ("DSA", "DSA"), ("MD5", "MD5"),
           ("SHA3", "SHA-3"), ("SHA2", "SHA-2"), ("SHA1", "SHA-1"), ("SHA", "SHA"), ("HMAC", "HMAC"), ("TLS", "TLS/SSL"), ("SSL", "TLS/SSL")]


def display_family(name: Column) -> Column:
    """The front end's own grouping, which differs from family()."""
    n = F.upper(F.coalesce(name, F.lit("")))
    return F.coalesce(F.when(n == "?", ""), *[F.when(n.startswith(begin), is_) for begin, is_ in DISPLAY], n)


def exposed(name: Column, horizon: tuple[float, float, float]) -> Column:
    """Data lifetime plus migration time exceed the years left, for names that aren't exempt."""
    data, migration, left = horizon
    return F.lit(data + migration > left) & ~base_algorithm(name).isin(rules.EXEMPT)


def severity(name: Column, key_size: Column, is_exposed: Column) -> Column:
    base = base_algorithm(name)
    short = F.coalesce((base == "RSA") & (key_size < rules.SHORT_RSA), F.lit(False))
    return (F.when(base.isin(rules.QUANTUM_VULNERABLE), F.when(short | is_exposed, "critical").otherwise("high"))
            .when(base.isin(rules.WEAK), F.when(is_exposed, "high").otherwise("medium"))
            .otherwise(F.when(is_exposed, "medium").otherwise("low")))


def _conditions(name: Column, key_size: Column, is_exposed: Column) -> list[tuple[Column, int, str]]:
    base = base_algorithm(name)
    short = F.coalesce((base == "RSA") & (key_size != 0) & (key_size < rules.SHORT_RSA), F.lit(False))
    return [(base.isin(rules.WEAK), 70, "weak"), (base.isin(rules.QUANTUM_VULNERABLE), 45, "quantum"), (short, 35, "short"),
            (base.isin(rules.LEGACY_PROTOCOLS), 20, "legacy"), (is_exposed & ~base.isin(rules.EXEMPT), 25, "exposed")]


def priority_score(name: Column, key_size: Column, is_exposed: Column) -> Column:
    total = F.lit(0)
    for holds, points, _ in _conditions(name, key_size, is_exposed):
        total = total + F.when(holds, points).otherwise(0)
    return F.least(total, F.lit(100))


def risk_factors(name: Column, key_size: Column, is_exposed: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(holds, rules.FACTORS[k]) for holds, _, k in _conditions(name, key_size, is_exposed)]))
    return F.when(F.size(found) == 0, F.array(F.lit(rules.FACTORS["none"]))).otherwise(found)


def priority(score: Column) -> Column:
    return F.when(score >= 90, "P0").when(score >= 65, "P1").when(score >= 30, "P2").otherwise("P3")


def evidence_strength(usage: Column, confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return (F.when(usage.isin(rules.STRONG_USAGES), "HIGH").when((usage == "binary string reference") | (c < 0.6), "LOW")
            .when((usage == "direct") & (c >= 0.8), "HIGH").otherwise("MEDIUM"))


def migration_status(sev: Column, pri: Column) -> Column:
    return (F.when(sev.isin("critical", "high") | pri.isin("P0", "P1"), "MIGRATION_REQUIRED")
            .when((sev == "medium") | (pri == "P2"), "MIGRATION_PLANNED").otherwise("DISCOVERED"))


def roadmap_bucket(sev: Column, pri: Column) -> Column:
    return (F.when((pri == "P0") | (sev == "critical"), "Immediate").when((pri == "P1") | (sev == "high"), "Near-term")
            .when((pri == "P2") | (sev == "medium"), "Planned").otherwise("Monitor"))


def recommendation(base: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.RECOMMENDATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, base), F.lit(rules.NO_RECOMMENDATION))


def digest(prefix: str, width: int, *parts: Column, bits: int = 1) -> Column:
    """Prefix and hex digits of a digest over parts joined by |; a null part reads None."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined) if bits == 1 else F.sha2(joined, 256), 1, width))


def finding_id(c=F.col) -> Column:
    return digest("", 12, *map(c, ("scanner", "file_path", "line", "algorithm", "category", "key_size", "curve", "usage")))


def finding_fingerprint(c=F.col) -> Column:
    """Without the line, so that it survives moves."""
    return digest("f", 11, *map(c, ("scanner", "file_path", "algorithm", "category", "key_size", "curve", "usage")))


def strip(text: Column) -> Column:
    """Unicode white space trimmed on both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def redacted(line: Column, limit: int = 160) -> Column:
    """Evidence without key material or values of secrets."""
    hidden = F.regexp_replace(strip(line), f"(?iuU){rules.SECRET}", "$1$2[REDACTED]")
    return F.when(line.rlike(f"(?iuU){rules.PRIVATE_KEY}"), "[REDACTED PRIVATE KEY MATERIAL]").otherwise(F.substring(hidden, 1, limit))


def masked_accounts(text: Column) -> Column:
    """Twelve-digit account numbers hidden."""
    return F.regexp_replace(text, r"(?U)\b\d{12}\b", "****")


def package_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "py", "python").when(ext.isin("js", "jsx", "ts", "tsx", "mjs", "cjs"), "javascript").otherwise("other")


def normal_path(path: Column) -> Column:
    """A path without empty, `.` and `..` segments: a fold with the segments so far as its stack; `..` at the top stays there."""
    stack = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda held, p: F.when(p.isin("", "."), held).when(
        p == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


def inside(path: Column, root: Column) -> Column:
    """Whether a normal path is a normal root or lies below it; `/ab` does not lie below `/a`."""
    return (path == root) | path.startswith(F.concat(F.regexp_replace(root, "/$", ""), F.lit("/")))


def jailed(path: Column, root: Column, longest: int = 1024) -> Column:
    """The normal form of a path, relative to the root unless absolute; null if it is blank or too long, climbs by `..`, or leaves the root."""
    top = normal_path(root)
    whole = normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(root, F.lit("/"), path)))
    safe = (F.trim(path) != "") & (F.length(path) <= longest) & ~F.array_contains(F.split(path, "/"), "..") & inside(whole, top)
    return F.when(safe, whole)


def strategy(name: Column, category: Column, usage: Column) -> Column:
    """Which validator fits a finding: tls, runtime, or none."""
    base = base_algorithm(name)
    return (F.when(usage == "dependency integrity metadata", "none")
            .when(category.isin("certificate", "protocol") | (base.isin(rules.TLS_NAMES) & category.isin("certificate", "protocol", "key")), "tls")
            .when(category.isin("library", "symmetric", "asymmetric", "hash") & ~base.isin("UNKNOWN", ""), "runtime")
            .when(category == "dependency", "runtime").otherwise("none"))


def code_score(confidence: Column, impact: Column, effort: Column, risk: Column) -> Column:
    level = lambda c: F.when(c == "HIGH", 3).when(c == "MEDIUM", 2).otherwise(1)
    size = F.when(effort == "SMALL", 1).when(effort == "MEDIUM", 2).otherwise(3)
    return level(confidence) * level(impact) / (size * level(risk))


def code_label(score: Column, confidence: Column, impact: Column, effort: Column, risk: Column) -> Column:
    return (F.when(risk == "HIGH", "DO_NOT_AUTOMATE").when(confidence == "LOW", "REQUIRES_REVIEW").when(score >= 3, "QUICK_WIN")
            .when(score >= 1.5, F.when(impact == "HIGH", "HIGH_IMPACT").otherwise("LOW_RISK"))
            .when(effort == "LARGE", "LARGE_REFACTOR").otherwise("REQUIRES_REVIEW"))
