"""Row generators: line rules to finding rows, in one pass and without joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import exprs, rules

#: Flags that give Java's expressions the Unicode case rules of the rules' origin.
FLAGS = "(?iuU)"


def _hit(name: Column, category: Column | str, confidence: float, ord_: int, *, size=None, mode: Column | None = None, proto="", lib: Column | str = "", usage: str = "direct") -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(ord_).alias("emit_ord"), text(name).alias("algorithm"), text(category).alias("category"), F.lit(confidence).cast("double").alias("confidence"),
        (F.lit(None) if size is None else size).cast("int").alias("key_size"), (F.lit("") if mode is None else mode).alias("mode"),
        text(proto).alias("protocol_version"), text(lib).alias("library"), F.lit(usage).alias("usage"))


def line_hits(file_name: Column, line: Column, low_line: Column) -> Column:
    """Array of what a line shows: a manifest's dependency first, then the rules in order, then a declared key size. A pattern
    is tried only on lines that hold one of the rule's needles, as a plain search in the folded line (low_line) tells."""
    held = lambda needles: reduce(lambda a, b: a | b, [low_line.contains(n) for n in needles])
    mode = F.upper(F.regexp_extract(line, FLAGS + rules.BLOCK_MODE, 1))
    low = F.lower(file_name)
    manifest = low.startswith("requirements") | low.isin(rules.MANIFESTS)
    tokens = [F.when(F.lower(line).rlike(r"(?<![a-z0-9_.-])" + t.replace("-", r"\-") + r"(?![a-z0-9_.-])"), n) for t, n in rules.MANIFEST_TOKENS]
    dependency = F.coalesce(*tokens)
    out = [F.when(manifest & dependency.isNotNull(), _hit(dependency, "dependency", 0.75, 0, lib=dependency, usage="dependency reference"))]
    integrity = low.isin(rules.LOCKFILES) & line.rlike(FLAGS + rules.INTEGRITY)
    for k, (pattern, name, category, confidence, hint) in enumerate(rules.LINE_RULES, 1):
        p = FLAGS + pattern
        if hint == "size":
            size = F.regexp_extract(line, p, 1)
            hit = _hit(F.concat(F.lit("AES-"), size), category, confidence, k, size=size, mode=mode)
        elif hint == "rsasize":
            size = F.regexp_extract(line, FLAGS + rules.RSA_SIZE, 1)
            hit = _hit(F.lit(name), category, confidence, k, size=F.when(size != "", size), mode=mode)
        elif hint == "curve":
            hit = _hit(F.lit(name), category, confidence, k, mode=mode, lib=F.regexp_extract(line, FLAGS + rules.CURVE, 1))
        elif hint == "proto":
            hit = _hit(F.lit(name), category, confidence, k, mode=mode, proto=name)
        elif hint == "lib":
            hit = _hit(F.lit(name), category, confidence, k, mode=mode, lib=F.regexp_extract(line, p, 0))
        elif hint == "pem":
            kind = F.regexp_extract(line, p, 1)
            hit = _hit(F.concat(F.lit("PEM-"), F.replace(kind, F.lit(" "), F.lit(""))), F.when(kind.contains("CERTIFICATE"), "certificate").otherwise("key"), confidence, k, mode=mode)
        else:
            hit = _hit(F.lit(name), category, confidence, k, mode=mode)
        if name in ("SHA-1", "SHA-2"):
            hit = F.when(integrity, _hit(F.lit(name), "dependency", min(confidence, 0.4), k, usage="dependency integrity metadata")).otherwise(hit)
        out.append(F.when(held(rules.LINE_NEEDLES[k - 1]) & line.rlike(p), hit))
    number = F.regexp_extract(line, FLAGS + rules.KEY_SIZE_NUMBER, 1)
    out.append(F.when(held(["key"]) & line.rlike(FLAGS + rules.KEY_SIZE_DECLARED), _hit(F.lit("KEYSIZE"), "key", 0.5, len(rules.LINE_RULES) + 1, size=F.when(number != "", number), usage="key size declaration")))
    return F.array_compact(F.array(*out))


def folded(text: Column) -> Column:
    """Text with the case folded as the patterns fold it: characters whose capital is a letter's capital become that letter."""
    return F.lower(F.upper(F.translate(text, "\u0130", "i")))


def line_findings(lines: DataFrame, scanner: str = "source") -> DataFrame:
    """(key, line, content) -> findings of one scan over the lines: a single projection and explode, no join, no shuffle."""
    name = F.element_at(F.split(F.col("key"), "/"), -1)
    needles = sorted({n for some in rules.LINE_NEEDLES for n in some if not any(o != n and o in n for more in rules.LINE_NEEDLES for o in more)} | {"key"})
    manifest = F.lower(name).startswith("requirements") | F.lower(name).isin(rules.MANIFESTS)
    # A lambda's variable holds the folded line once, where a column would be put in wherever it is named; explode_outer, as for
    # explode the optimiser would add a filter that works out the whole array once more.
    low = F.array(folded(F.col("content")))
    some = lines.where(F.exists(low, lambda x: reduce(lambda a, b: a | b, [x.contains(n) for n in needles])) | manifest)
    found = F.flatten(F.transform(low, lambda x: line_hits(name, F.col("content"), x)))
    hits = some.withColumn("hit", F.explode_outer(found)).where("hit is not null")
    rows = hits.select(F.lit(scanner).alias("scanner"), F.col("key").alias("file_path"), "line", "hit.*", exprs.redacted(F.col("content")).alias("evidence"), F.lit("").alias("curve"), F.lit("").alias("signature_algorithm"), F.lit("").alias("expires_at"), F.lit(False).alias("is_mock"))
    return rows.withColumn("id", exprs.finding_id())


def _rows(lines: DataFrame, hits: Column, scanner: str) -> DataFrame:
    """(key, line, content) with an array of hits that carry their evidence -> findings."""
    return lines.withColumn("hit", F.explode(hits)).select(F.lit(scanner).alias("scanner"), F.col("key").alias("file_path"), "line", "hit.*", F.lit("").alias("curve"))


def _evident(hit: Column, evidence: Column) -> Column:
    return hit.withField("evidence", evidence)


def cloud_findings(lines: DataFrame) -> DataFrame:
    """Managed-key references: one hit of each provider's chain at most, a TLS policy, and a named key reference whose value is
    kept only if it looks like an identifier."""
    line, hits = F.col("content"), []
    plain = F.substring(exprs.strip(line), 1, 160)
    for k, chain in enumerate(rules.CLOUD_CHAINS):
        of_chain = []
        for pattern, fold, name, provider, confidence, match in chain:
            p = (FLAGS if fold else "(?U)") + pattern
            seen = F.substring(exprs.masked_accounts(F.regexp_extract(line, p, 0)), 1, 160) if match else plain
            of_chain.append(F.when(line.rlike(p), _evident(_hit(F.lit(name), "key", confidence, k, lib=provider, usage="cloud crypto configuration"), seen)))
        hits.append(F.coalesce(*of_chain))
    p = "(?U)" + rules.KEY_REFERENCE
    value = F.regexp_replace(F.regexp_extract(line, p, 2), "^([\"'])(.*)\\1$", "$2")
    shown = F.when(value.rlike(rules.KEY_IDENTIFIER), F.substring(exprs.masked_accounts(value), 1, 96)).otherwise("[REDACTED]")
    hits.append(F.when(line.rlike(p), _evident(_hit(F.lit("KMS"), "key", 0.55, len(hits), lib="config-reference", usage="cloud crypto configuration"), F.concat(F.regexp_extract(line, p, 1), F.lit(" = "), shown))))
    return _rows(lines, F.array_compact(F.array(*hits)), "cloud")


def redacted_uri(uri: Column) -> Column:
    """A PKCS#11 URI with the values of a few harmless attributes only."""
    head, query = F.split_part(uri, F.lit("?"), F.lit(1)), uri.contains("?")
    parts = F.split(head, ";")
    kept = F.filter(F.slice(parts, 2, F.size(parts)), lambda a: a.contains("=") & F.lower(F.trim(F.split_part(a, F.lit("="), F.lit(1)))).isin(rules.PKCS11_KEPT))
    shown = F.concat(F.element_at(parts, 1), F.when(F.size(parts) == 1, "").when(F.size(kept) > 0, F.concat(F.lit(";"), F.array_join(kept, ";"))).otherwise(";[ATTRIBUTES-REDACTED]"))
    return F.substring(F.concat(shown, F.when(query & (F.split_part(uri, F.lit("?"), F.lit(2)) != ""), "?[QUERY-REDACTED]").otherwise("")), 1, 160)


def hsm_findings(lines: DataFrame) -> DataFrame:
    """PKCS#11 URIs, modules or else vendors, providers; configuration keys (all of a line) only where none of them stands."""
    line = F.col("content")
    uri, module, vendor, provider = (FLAGS + p for p in (rules.PKCS11_URI, rules.HSM_MODULE, rules.HSM_VENDOR, rules.HSM_PROVIDER))
    found = F.regexp_extract(line, module, 0)
    path = F.regexp_extract(found, FLAGS + rules.HSM_MODULE_PATH, 0)
    hit = lambda name, category, confidence, k, lib: _hit(F.lit(name), category, confidence, k, lib=F.substring(lib, 1, 64), usage="hsm integration reference")
    strong = F.array_compact(F.array(
        F.when(line.rlike(uri), hit("PKCS11", "key", 0.85, 0, F.lit("PKCS#11 URI"))),
        F.when(line.rlike(module), hit("PKCS11", "library", 0.8, 1, F.when(path != "", path).otherwise(found))).when(line.rlike(vendor), hit("HSM", "library", 0.6, 1, F.regexp_extract(line, vendor, 0))),
        F.when(line.rlike(provider), hit("PKCS11", "library", 0.75, 2, F.lit("provider configuration")))))
    keys = F.transform(F.regexp_extract_all(line, F.lit("(?U)" + rules.HSM_CONFIG_KEY), F.lit(1)), lambda k: hit("HSM", "key", 0.55, 3, k))
    evidence = F.when(line.rlike(uri), redacted_uri(F.regexp_extract(line, uri, 0))).otherwise(F.substring(F.regexp_replace(exprs.strip(line), FLAGS + rules.SECRET, "$1$2[REDACTED]"), 1, 160))
    hits = F.transform(F.when(F.size(strong) > 0, strong).otherwise(keys), lambda h: _evident(h, evidence))
    return _rows(lines, hits, "hsm")


def binary_findings(strings: DataFrame, limit: int | None = 100) -> DataFrame:
    """(path, place, content) of printable strings -> distinct findings per file in order of place, at most `limit` a file (None: all)."""
    text, hits = F.col("content"), []
    for k, (pattern, name) in enumerate(rules.BINARY_LIBRARIES):
        hits.append(F.when(text.rlike(FLAGS + pattern), _evident(_hit(F.lit(name), "library", 0.8, k, lib=F.regexp_extract(text, FLAGS + pattern, 0), usage="binary library reference"), F.regexp_extract(text, FLAGS + pattern, 0))))
    for k, (begin, name) in enumerate(rules.BINARY_SYMBOLS, 100):
        hits.append(F.when(text.rlike(FLAGS + r"\b" + begin), _evident(_hit(F.lit(name), "library", 0.7, k, usage="binary symbol reference"), F.substring(text, 1, 160))))
    for k, (pattern, name, category) in enumerate(rules.BINARY_ALGORITHMS, 200):
        p = FLAGS + pattern
        size = F.regexp_extract(text, p, 1) if name in ("AES", "RSA") else F.lit("")
        label = F.concat(F.lit("AES-"), size) if name == "AES" else F.lit(name)
        hits.append(F.when(text.rlike(p), _evident(_hit(label, category, 0.55, k, size=F.when(size != "", size), proto=F.regexp_extract(text, p, 0) if name == "TLS" else "", usage="binary string reference"), F.regexp_extract(text, p, 0))))
    rows = strings.select(F.col("path").alias("file_path"), "place", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("file_path", "place", "hit.*")
    first = Window.partitionBy("file_path", "usage", "algorithm", "evidence").orderBy("place", "emit_ord")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    if limit is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file_path").orderBy("place", "emit_ord"))).where(F.col("_n") <= limit)
    return rows.drop("_n").withColumn("scanner", F.lit("binary")).withColumn("line", F.lit(0))


def package_findings(packages: DataFrame) -> DataFrame:
    """(path, name, version) of declared packages -> crypto dependencies, looked up by short module name, then normalised name."""
    table = F.create_map(*[F.lit(x) for k, (label, c) in rules.PACKAGES.items() for x in (k, f"{label}|{c}")])
    parts = F.split("name", "/")
    short = F.when((F.size(parts) >= 3) & (F.element_at(parts, -2) == "x"), F.concat(F.lit("x-"), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))
    found = F.coalesce(F.try_element_at(table, F.lower(short)), F.try_element_at(table, exprs.package_name(F.col("name"))))
    rows = packages.withColumn("_found", found).where("_found is not null")
    return rows.select(F.lit("dependency").alias("scanner"), F.col("path").alias("file_path"), F.lit(0).alias("line"), F.split_part("_found", F.lit("|"), F.lit(1)).alias("algorithm"), F.lit("dependency").alias("category"),
                       F.col("name").alias("library"), F.split_part("_found", F.lit("|"), F.lit(2)).cast("double").alias("confidence"), F.lit("dependency reference").alias("usage"), "version")
