"""Queries of detection, validation, notes and records on inputs that fixed arithmetic makes of the given tables; and their SQL.

The SQL works out from the same numbers what must come out; it does not see the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import code, detect, notes, relate, score, structure, validate
from siltstone.plans import codebase, lifecycle, oracle, report, scan
from siltstone.plans.oracle import names
from siltstone.sources import files, manifests, x509
from siltstone.sources.shared import kept
from siltstone.sources.tables import lines, load, synthetic_findings
from siltstone.streaming import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


# Lines: each document is a file of two lines out of a table of templates; what a template holds was read from the rules

#: (line, [(algorithm, category, key size, mode, usage)]).
LINES = [
    ("cipher = AES_256 in GCM mode", [("AES-256", "symmetric", 256, "GCM", "direct")]), ("key_size=2048", [("KEYSIZE", "key", 2048, "", "key size declaration")]),
    ("DES old, md5 and SHA1", [("DES", "symmetric", None, "", "direct"), ("MD5", "hash", None, "", "direct"), ("SHA-1", "hash", None, "", "direct")]), ("password = 'hunter2'", []),
    ("ssl.PROTOCOL_TLSv1_2", [("TLS1.2", "protocol", None, "", "direct")]), ("RSA with 1024 bits", [("RSA", "asymmetric", 1024, "", "direct")]),
    ("-----BEGIN CERTIFICATE-----", [("PEM-CERTIFICATE", "certificate", None, "", "direct")]), ("f.key_size", []), ("unsha1ed and destined", []), ("if x.key_size:", []), ("key_size: 4096", [("KEYSIZE", "key", 4096, "", "key size declaration")]),
]
#: (line, [(scanner, algorithm, category, library, confidence)]).
CONFIGS = [
    ("arn:aws:kms:eu-west-1:123456789012:key/abc", [("cloud", "KMS", "key", "aws:kms", 0.85)]), ("https://v1.vault.azure.net/keys/k", [("cloud", "KEYVAULT", "key", "azure:keyvault", 0.85)]),
    ("SIGN_KEY_ID = abc", [("cloud", "KMS", "key", "config-reference", 0.55)]), ("pkcs11:token=t;object=o?pin-value=1", [("hsm", "PKCS11", "key", "PKCS#11 URI", 0.85)]), ("Thales nShield", [("hsm", "HSM", "library", "nShield", 0.6)]),
    ("IconShield", []), ("HSM_SLOT=3 HSM_PIN=1", [("cloud", "KMS", "key", "config-reference", 0.55), ("hsm", "HSM", "key", "HSM_SLOT", 0.55), ("hsm", "HSM", "key", "HSM_PIN", 0.55)]),
    ("/usr/lib/libsofthsm2-pkcs11.so", [("hsm", "PKCS11", "library", "/usr/lib/libsofthsm2-pkcs11.so", 0.8)]),
]


def _two_lines(spark: SparkSession, d: str, templates: list, folder: str, suffix: str) -> DataFrame:
    """(path, text)."""
    i = F.col("doc_id")
    said = [t for t, _ in templates]
    text = F.concat_ws("\n", pick(said, i % len(said)), pick(said, (i * 7 + 3) % len(said)))
    return load(spark, d, "documents").select(F.concat(F.lit(folder), i.cast("string"), F.lit(suffix)).alias("path"), text.alias("text"))


def _expected(templates: list, columns: str, folder: str, suffix: str) -> str:
    """SQL of (path, line, ...columns): the rows of both templates of each document."""
    rows = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in (k, *r)) + ")" for k, (_, held) in enumerate(templates) for r in held)
    n = len(templates)
    return (f"(SELECT '{folder}' || doc_id || '{suffix}' AS path, l AS line, {columns} FROM (SELECT doc_id, unnest([1, 2]) AS l FROM documents) x JOIN (VALUES {rows}) AS t(k, {columns}) "
            f"ON t.k = CASE l WHEN 1 THEN doc_id % {n} ELSE (doc_id * 7 + 3) % {n} END)")


SOURCE_ROWS = _expected(LINES, "algorithm, category, key_size, mode, usage", "app/x", ".py")


@query(f"SELECT path AS file_path, line, algorithm, category, key_size::INT AS key_size, mode, usage FROM {SOURCE_ROWS}")
def line_findings(spark, d):
    texts = _two_lines(spark, d, LINES, "app/x", ".py")
    return detect.line_findings(lines(texts, F.col("path"), F.col("text"))).select("file_path", "line", "algorithm", "category", "key_size", "mode", "usage")


CONFIG_ROWS = _expected(CONFIGS, "scanner, algorithm, category, library, confidence", "conf/x", ".tf")


@query(f"SELECT path AS file_path, line, scanner, algorithm, category, library, confidence::DOUBLE AS confidence FROM {CONFIG_ROWS}")
def cloud_hsm_findings(spark, d):
    texts = _two_lines(spark, d, CONFIGS, "conf/x", ".tf")
    rows = lines(texts, F.col("path"), F.col("text"))
    return detect.cloud_findings(rows).unionByName(detect.hsm_findings(rows)).select("file_path", "line", "scanner", "algorithm", "category", "library", "confidence")


# Binaries: a magic number or none, and three of the strings, one of them twice

STRINGS = [("libcrypto.so.3", "OpenSSL", "library", None, "binary library reference"), ("EVP_EncryptInit", "OpenSSL", "library", None, "binary symbol reference"), ("AES-256", "AES-256", "symmetric", 256, "binary string reference"),
           ("RSA 2048", "RSA", "asymmetric", 2048, "binary string reference"), ("TLSv1.2", "TLS", "protocol", None, "binary string reference"), ("noise", None, None, None, None)]


def _binaries(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    at = lambda k: pick([s[0] for s in STRINGS], (i * k + k) % len(STRINGS))
    head = F.when(i % 4 == 0, F.unhex(F.lit("7F454C46"))).when(i % 4 == 1, F.unhex(F.lit("4D5A"))).when(i % 4 == 2, F.unhex(F.lit("CAFEBABE"))).otherwise(F.lit(b"text"))
    body = F.encode(F.concat(F.lit("\0"), at(1), F.lit("\0ab\0"), at(5), F.lit("\0"), at(1), F.lit("\0"), at(2), F.lit("\0")), "UTF-8")
    content = F.concat(head, body)
    return load(spark, d, "documents").select(F.concat(F.lit("bin/x"), i.cast("string")).alias("path"), content.alias("content"), F.length(content).cast("long").alias("length"))


HELD = "(VALUES " + ", ".join(f"({k}, '{a}', '{c}', {'NULL' if z is None else z}, '{u}', '{s}')" for k, (s, a, c, z, u) in enumerate(STRINGS) if a) + ") AS t(k, algorithm, category, key_size, usage, evidence)"
#: Places of strings of four characters and more; the third repeats the first.
BINARY_ROWS = f"(SELECT DISTINCT 'bin/x' || doc_id AS path, algorithm, category, key_size::INT AS key_size, usage, evidence FROM (SELECT doc_id, unnest([1, 5, 2]) AS m FROM documents WHERE doc_id % 4 <> 3) x JOIN {HELD} ON t.k = (doc_id * m + m) % {len(STRINGS)})"


@query(f"SELECT path AS file_path, algorithm, category, key_size, usage, evidence FROM {BINARY_ROWS}")
def binary_findings(spark, d):
    return detect.binary_findings(files.binary_strings(_binaries(spark, d), None), None).select("file_path", "algorithm", "category", "key_size", "usage", "evidence")


# A scan of all of these files: sources, configuration, binaries and manifests

SCANNED = f"""source AS (SELECT 'source' AS scanner, path, line, algorithm, category, key_size::INT AS key_size, mode, '' AS library, usage FROM {SOURCE_ROWS}),
conf AS (SELECT scanner, path, line, algorithm, category, NULL::INT, '', library, 'u' FROM {CONFIG_ROWS}),
bin AS (SELECT DISTINCT 'binary', path, 0, algorithm, category, key_size, '', CASE WHEN usage = 'binary library reference' THEN evidence ELSE '' END, usage FROM {BINARY_ROWS})"""


@query(f"WITH {SCANNED} SELECT scanner, algorithm, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT * FROM source UNION ALL SELECT * FROM conf UNION ALL SELECT * FROM bin)) GROUP BY ALL")
def scan_tree(spark, d):
    """Counts of a whole scan without limits, by scanner and algorithm."""
    texts = _two_lines(spark, d, LINES, "app/x", ".py").unionByName(_two_lines(spark, d, CONFIGS, "conf/x", ".tf").where("false"))
    as_files = lambda t: t.select("path", F.encode("text", "UTF-8").alias("content")).withColumn("length", F.length("content").cast("long"))
    source = scan.scan_files(as_files(texts), ["source"])
    conf = scan.scan_files(as_files(_two_lines(spark, d, CONFIGS, "conf/x", ".tf")), ["cloud", "hsm"])
    binary = scan.scan_files(_binaries(spark, d), ["binary"], limits=scan.NO_LIMITS)
    every = source.select("scanner", "algorithm").unionByName(conf.select("scanner", "algorithm")).unionByName(binary.select("scanner", "algorithm"))
    return every.groupBy("scanner", "algorithm").agg(F.count(F.lit(1)).alias("n"))


# Certificates: the end of validity is written into a certificate's bytes

#: A self-signed certificate made for this purpose.
CERTIFICATE = """-----BEGIN CERTIFICATE-----
MIIBbTCCAROgAwIBAgIUdjQSv1inpo+q5AmtPYlFvIQg0N0wCgYIKoZIzj0EAwIw
DDEKMAgGA1UEAwwBdDAeFw0yNjExMjYxNTE0MzNaFw0yNjEyMjYxNTE0MzNaMAwx
CjAIBgNVBAMMAXQwWTATBgcqhkjOPQIBBggqhkjOPQMBBwNCAAQEiz4TZuD6rzAf
Ihg/mrr1YosgOA8rbEd2G9tEXDJn0IikeJAArpkN+o9XocKHemwbO5c+3UgB9uLk
4tu+lUh1o1MwUTAdBgNVHQ4EFgQUvgok/+W7v85fYshfFVpmxIBp7XswHwYDVR0j
BBgwFoAUvgok/+W7v85fYshfFVpmxIBp7XswDwYDVR0TAQH/BAUwAwEB/zAKBggq
hkjOPQQDAgNIADBFAiBusBuA++tzL+IAFeXlqZcee5WYaHpwK95OPsL8qOaoewIh
AO8/4yO3VMza44+KcP0cMIGF7oGl5j5vXKlLeYrBF7S4
-----END CERTIFICATE-----
"""


@query("SELECT 'c' || doc_id || '.pem' AS path, 'ECDSA' AS algorithm, 'P-256' AS curve, 'ECDSA-SHA-256' AS signature_algorithm, '203' || doc_id % 10 || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || 'T15:14:33+00:00' AS expires_at FROM documents WHERE doc_id % 5 <> 4")
def certificates(spark, d):
    i = F.col("doc_id")
    body = "".join(CERTIFICATE.strip().split("\n")[1:-1])
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date = F.concat(F.lit("3"), (i % 10).cast("string"), two(1 + i % 12), two(1 + i % 28))
    der = F.overlay(F.unbase64(F.lit(body)), F.encode(date, "UTF-8"), 81, 6)
    pem = F.concat(F.lit("-----BEGIN CERTIFICATE-----\n"), F.base64(der), F.lit("\n-----END CERTIFICATE-----\n"))
    broken = F.concat(F.substring(pem, 1, 90), F.lit("\n-----END CERTIFICATE-----\n"))
    texts = load(spark, d, "documents").select(F.concat(F.lit("c"), i.cast("string"), F.lit(".pem")).alias("path"), F.when(i % 5 == 4, broken).otherwise(pem).alias("text"))
    return x509.certificates(texts).select("path", "algorithm", "curve", "signature_algorithm", "expires_at")


# Validation: findings of an order number modulo fifty meet one address; programs report what they use

BASE, FAMILY = oracle.base("algorithm"), oracle.family
REASON = f"""CASE WHEN usage = 'dependency integrity metadata' THEN 'lockfile integrity metadata is not runtime-probed' WHEN validator = 'tls' THEN base || ' ' || category || ' evidence maps to TLS/certificate observation'
 WHEN validator = 'runtime' AND category = 'dependency' THEN 'dependency reference maps to runtime library-usage observation' WHEN validator = 'runtime' THEN base || ' ' || category || ' evidence maps to runtime crypto observation' ELSE 'no automatic validator for ' || base || ' ' || category || ' evidence' END"""
S = oracle.E_ + f", s AS (SELECT *, {oracle.STRATEGY} AS validator FROM e)"


@query(S + f" SELECT ord, validator, {REASON} AS reason FROM s")
def validation_strategies(spark, d):
    e = score.enrich(synthetic_findings(spark, d))
    return e.select("ord", validate.strategy_reason(F.col("algorithm"), F.col("category"), F.col("usage")).alias("s")).select("ord", "s.*")


VERSIONS, SEEN, SIZES = ["TLSv1.2", "TLSv1.3", "TLSv1.0"], ["RSA", "EC", "ECDSA", ""], [2048, 1024, None]
T = S + f""", t AS (SELECT n, CASE WHEN n % 5 = 0 THEN 'http' ELSE 'https' END || '://h' || n || '.example' AS url, n % 5 <> 0 AS https, n % 7 = 3 AS failed, {listed(VERSIONS)}[n % 3 + 1] AS version, {listed(SEEN)}[n % 4 + 1] AS seen, {listed(SIZES)}[n % 3 + 1] AS size FROM range(50) r(n)),
c AS (SELECT DISTINCT id, algorithm, key_size, base, okey % 50 AS n FROM s WHERE validator = 'tls'),
m AS (SELECT c.*, t.* EXCLUDE (n), CASE base WHEN 'TLS10' THEN 'TLSv1' WHEN 'TLS12' THEN 'TLSv1.2' END AS claimed, {FAMILY('base')} AS own, {FAMILY('seen')} AS other FROM c JOIN t USING (n)),
v AS (SELECT *, CASE WHEN NOT https THEN 'NOT_APPLICABLE' WHEN failed THEN 'ERROR' WHEN claimed IS NOT NULL THEN CASE WHEN starts_with(version, claimed) THEN 'CONFIRMED' ELSE 'NOT_CONFIRMED' END
  WHEN seen <> '' AND other = own THEN CASE WHEN key_size = size THEN 'CONFIRMED' ELSE 'PARTIALLY_CONFIRMED' END ELSE 'NOT_CONFIRMED' END AS v_status FROM m),
tls AS (SELECT id AS finding_id, url AS target, v_status, CASE WHEN NOT https THEN 1.0 WHEN failed THEN 0.5 WHEN claimed IS NOT NULL THEN CASE v_status WHEN 'CONFIRMED' THEN 0.85 ELSE 0.7 END WHEN v_status = 'CONFIRMED' THEN 0.8 WHEN v_status = 'PARTIALLY_CONFIRMED' THEN 0.65 ELSE 0.6 END::DOUBLE AS confidence,
  CASE WHEN NOT https THEN 'plain-http target carries no TLS to observe' WHEN failed THEN 'tls probe failed: TimeoutError' WHEN claimed IS NOT NULL AND v_status = 'CONFIRMED' THEN 'observed ' || version || ' matches static claim ' || base
    WHEN claimed IS NOT NULL THEN 'observed ' || version || '; static claim ' || base || ' not observed in this handshake' WHEN v_status = 'CONFIRMED' THEN 'same family ' || other || ' and key size ' || size || ' observed'
    WHEN v_status = 'PARTIALLY_CONFIRMED' THEN 'same family ' || other || ' observed (sig sha256); key-size match ' || CASE WHEN key_size IS NULL THEN 'not checked' ELSE 'differs' END
    ELSE 'observed ' || CASE WHEN seen = '' THEN 'unknown' ELSE other END || ' vs static claim ' || base END AS note FROM v)"""


def _tls(spark: SparkSession, d: str) -> DataFrame:
    e = score.enrich(synthetic_findings(spark, d))
    n = F.col("n")
    targets = e.groupBy((F.col("okey") % 50).alias("n")).agg(F.collect_set("id").alias("finding_ids"))  # an address with its list
    https = F.when(n % 5 == 0, "http").otherwise("https")
    targets = targets.select(F.concat(https, F.lit("://h"), n.cast("string"), F.lit(".example")).alias("url"), "finding_ids", pick(VERSIONS, n % 3).alias("tls_version"), F.lit("sha256").alias("signature_algorithm"),
                             pick(SEEN, n % 4).alias("public_key_algorithm"), F.when(n % 3 == 0, 2048).when(n % 3 == 1, 1024).alias("tls_key_size"), F.when(n % 7 == 3, "TimeoutError").alias("error"))
    return validate.tls_results(e.select("id", "algorithm", "category", "usage", "key_size").distinct(), targets).where("finding_id <> ''")


@query(T + " SELECT * FROM tls")
def validation_tls_results(spark, d):
    return _tls(spark, d).select("finding_id", "target", "v_status", "confidence", "note")


REPORTED = ["SHA-384", "MD5", "bcrypt", "RSA", "AES"]
R = f""", o AS (SELECT {FAMILY('a')} AS family, arg_min(a, event_id) AS a, arg_min(t, event_id) AS t FROM (SELECT {listed(REPORTED)}[event_id % 7 % 5 + 1] AS a, 'probe ' || event_type AS t, event_id FROM events) GROUP BY ALL),
run AS (SELECT DISTINCT id AS finding_id, coalesce(t, 'runtime probe (bundled fixture)') AS target, CASE WHEN a IS NULL THEN 'NOT_CONFIRMED' ELSE 'CONFIRMED' END AS v_status, coalesce(a, '') AS observed_algorithm FROM s LEFT JOIN o ON o.family = s.family WHERE validator = 'runtime')"""


def _runtime(spark: SparkSession, d: str) -> DataFrame:
    seen = load(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat(F.lit("probe "), "event_type").alias("target"), pick(REPORTED, F.col("event_id") % 7 % 5).alias("observed_algorithm"))
    return validate.runtime_results(score.enrich(synthetic_findings(spark, d)).select("id", "algorithm", "category", "usage").distinct(), seen)


@query(S + R + " SELECT * FROM run")
def validation_runtime_results(spark, d):
    return _runtime(spark, d).select("finding_id", "target", "v_status", "observed_algorithm")


@query(T + R + " SELECT v_status, count(*) AS n FROM (SELECT v_status FROM tls UNION ALL SELECT v_status FROM run) GROUP BY ALL")
def validation_run_summary(spark, d):
    return validate.run_summary(_tls(spark, d).unionByName(_runtime(spark, d)))


ADDRESSES = ["https://localhost/{i}", "http://127.0.0.{b}:8080/{i}", "https://[::1]:8443/{i}", "https://Allowed.example./{i}", "https://h{i}.example/", "ftp://localhost/{i}", "https://u:p{i}@localhost/", "https://localhost:0/{i}", "https://localhost:{c}/", "https://localhost:x{i}/", "https://", "https://a\t{i}/"]
FAULTS = [None, None, None, None, "other", "only http/https URLs may be probed", "URLs with credentials are never probed", "URL port out of range", "URL port is invalid", "URL port is invalid", "URL host is missing or malformed", "URL contains control characters"]


@query(f"SELECT page_id, CASE {listed(FAULTS)}[page_id % 12 + 1] WHEN 'other' THEN 'host ''h' || page_id || '.example'' is not loopback; allowlist it or acknowledge non-loopback probing explicitly' ELSE {listed(FAULTS)}[page_id % 12 + 1] END AS fault FROM pages")
def validation_addresses(spark, d):
    i = F.col("page_id")
    url = F.lit("")
    for k, a in enumerate(ADDRESSES):
        url = F.when(i % 12 == k, codebase.filled(a, i=i, b=i % 256, c=65536 + i)).otherwise(url)
    return load(spark, d, "pages").select("page_id", validate.address_fault(url, ["allowed.example"]).alias("fault"))


# Telemetry categories: every pair of a name and an operation that fixed arithmetic gives

ALGOS, OPS = ["SHA-256", "RSA", "AES", "x", "ML-KEM", "ed25519", "ChaCha20", "RC4", "hkdf", "BLAKE2", "TLS1.3", "other", "ssl", "Dsa"], ["digest", "mac", "kdf", "random", "handshake", "context", "sign", "use"]


@query(f"""SELECT event_id, CASE WHEN op IN ('digest', 'mac', 'kdf') THEN 'hash' WHEN op = 'random' THEN 'key' WHEN op IN ('context', 'handshake') THEN 'protocol'
  ELSE {listed(['hash', 'asymmetric', 'symmetric', 'unknown', 'asymmetric', 'asymmetric', 'symmetric', 'symmetric', 'hash', 'hash', 'protocol', 'unknown', 'protocol', 'asymmetric'])}[event_id % 14 + 1] END AS category
FROM (SELECT event_id, {listed(OPS)}[event_id // 14 % 8 + 1] AS op FROM events)""")
def telemetry_categories(spark, d):
    i = F.col("event_id")
    return load(spark, d, "events").select("event_id", telemetry.category(pick(ALGOS, i % 14), pick(OPS, F.floor(i / 14) % 8)).alias("category"))


# Notes of documents


def _note(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, 200)


@query("""WITH n AS (SELECT doc_id AS i, CASE WHEN doc_id % 11 = 0 THEN 'k' || doc_id || '/id_rsa.md' ELSE 'n' || doc_id || '.md' END AS path, CASE WHEN doc_id % 4 = 0 THEN '[REDACTED: sensitive configuration omitted] and more' ELSE 'note ' || doc_id END AS text FROM documents)
SELECT path, CASE WHEN i % 11 = 0 THEN 'refused' WHEN i % 3 = 2 THEN 'created' WHEN i % 3 = 0 THEN 'unchanged' ELSE 'refused' END AS action, text FROM n""")
def note_writes(spark, d):
    i = F.col("doc_id")
    path = F.when(i % 11 == 0, codebase.filled("k{i}/id_rsa.md", i=i)).otherwise(codebase.filled("n{i}.md", i=i))
    said = F.when(i % 4 == 0, codebase.filled("api_key = s{i} and more", i=i)).otherwise(codebase.filled("note {i}", i=i))
    stored = F.when(i % 3 == 1, "another").otherwise(F.when(i % 4 == 0, "[REDACTED: sensitive configuration omitted] and more").otherwise(said))
    rows = load(spark, d, "documents").select(path.alias("path"), said.alias("text"), stored.alias("old"), i.alias("i"))
    return notes.note_writes(rows.select("path", "text"), rows.where("i % 3 <> 2").select("path", F.col("old").alias("text")))


@query("""WITH t AS (SELECT doc_id, left(coalesce(text, ''), 200) AS x FROM documents), c AS (SELECT *, regexp_replace(left(regexp_replace(regexp_replace(lower(regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), '^-+|-+$', '', 'g') AS s FROM t)
SELECT doc_id, CASE WHEN s = '' THEN 'note' ELSE s END AS slug FROM c""")
def note_slugs(spark, d):
    return load(spark, d, "documents").select("doc_id", notes.note_slug(_note(F.col("text"))).alias("slug"))


@query("""SELECT 'n/' || doc_id || '.md' AS path, unnest([{'key': 'owner', 'value': 'x' || doc_id}, {'key': 'a.b-c', 'value': '' || doc_id % 7}], recursive := true) FROM documents""")
def note_key_values(spark, d):
    i = F.col("doc_id")
    text = codebase.filled("owner = x{i}\nno pair\n a.b-c=  {k} \nowner = other\n= none\n", i=i, k=i % 7)
    return notes.key_values(load(spark, d, "documents").select(codebase.filled("n/{i}.md", i=i).alias("path"), text.alias("text")))


@query("SELECT DISTINCT 'n/' || doc_id || '.md' AS path, unnest(['n/' || doc_id % 9, 'm ' || doc_id]) AS target FROM documents")
def note_links(spark, d):
    i = F.col("doc_id")
    text = codebase.filled("see [[n/{k}]] and [[n/{k}|shown]], [[m {i}#part]], [not], [[]]", i=i, k=i % 9)
    return notes.links(load(spark, d, "documents").select(codebase.filled("n/{i}.md", i=i).alias("path"), text.alias("text")))


REPOSITORIES = ["https://github.com/owner{i}/name", "https://github.com/o-{i}/name.git", "https://github.com/owner/n.{i}/tree/main", "https://www.github.com/owner/n/commit/c{i}/", "http://github.com/owner/{i}", "https://user@github.com/owner/{i}", "https://github.com/owner{i}/..", "https://example.com/owner/{i}", "https://github.com/-{i}/name"]


@query("""SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'owner' || page_id WHEN 1 THEN 'o-' || page_id WHEN 2 THEN 'owner' WHEN 3 THEN 'owner' END AS owner, CASE page_id % 9 WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 2 THEN 'n.' || page_id WHEN 3 THEN 'n' END AS name,
  CASE page_id % 9 WHEN 2 THEN 'main' WHEN 3 THEN 'c' || page_id END AS ref FROM pages""")
def repository_addresses(spark, d):
    i = F.col("page_id")
    url = F.lit("")
    for k, a in enumerate(REPOSITORIES):
        url = F.when(i % 9 == k, codebase.filled(a, i=i)).otherwise(url)
    return load(spark, d, "pages").select("page_id", notes.repository(url).alias("r")).select("page_id", "r.*")


# Records of scans


@query("""WITH r AS (SELECT event_id, event_id % 6 IN (0, 1, 2) AS good FROM events), k AS (SELECT event_id FROM r WHERE good QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 500)
SELECT event_id || '.json' AS path, CASE WHEN NOT good THEN 'quarantined' WHEN event_id IN (SELECT event_id FROM k) THEN 'indexed' ELSE 'expired' END AS state, CASE WHEN good THEN 's' || event_id END AS scan_id, CASE WHEN event_id % 6 IN (3, 4) THEN 0 ELSE event_id END::DOUBLE AS scan_time FROM r""")
def scan_index_repair(spark, d):
    i = F.col("event_id")
    forms = ['{"id": "s{i}", "timestamp": {i}.0, "report": {"x": "1"}}', '{"id": "s{i}", "timestamp": {i}.0, "report": {}}', '{"timestamp": {i}.0, "report": {}, "id": "s{i}"}', "{broken", "", '{"id": "../{i}", "timestamp": {i}.0, "report": {}}']
    text = F.lit("")
    for k, form in enumerate(forms):
        text = F.when(i % 6 == k, F.replace(F.lit(form), F.lit("{i}"), i.cast("string"))).otherwise(text)
    return report.repaired_index(load(spark, d, "events").select(codebase.filled("{i}.json", i=i).alias("path"), text.alias("text")))


@query("SELECT 's' || event_id AS scan_id, CASE WHEN event_id % 3 <> 0 THEN event_id ELSE event_id + 0.5 END::DOUBLE AS scan_time FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0")
def scan_history_with_legacy(spark, d):
    rows = load(spark, d, "events").select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("scan_id"), F.col("event_id").cast("double").alias("scan_time"), "event_id")
    return report.history_with_legacy(rows.where("event_id % 3 <> 0").drop("event_id"), rows.where("event_id % 2 = 0").select("scan_id", (F.col("scan_time") + 0.5).alias("scan_time")))


@query("""WITH n AS (SELECT 's' || lpad((event_id % 40)::VARCHAR, 2, '0') AS scope, bool_and(event_id % 40 % 5 <> 1 OR event_id % 80 < 40) AS managed FROM events GROUP BY 1)
SELECT scope, CASE WHEN row_number() OVER (ORDER BY scope DESC) <= 5 THEN 'kept' WHEN managed THEN 'removed' ELSE 'skipped' END AS action FROM n""")
def scan_scopes_pruned(spark, d):
    i = F.col("event_id")
    rows = load(spark, d, "events").select(F.concat(F.lit("s"), F.lpad((i % 40).cast("string"), 2, "0")).alias("scope"), codebase.filled("n{i}.md", i=i).alias("path"), ((i % 40 % 5 != 1) | (i % 80 < 40)).alias("managed"))
    current = load(spark, d, "events").select(F.lit("current").alias("scope"), codebase.filled("c{i}.md", i=i).alias("path"), F.lit(True).alias("managed"))
    return report.pruned_scopes(rows.unionByName(current))


@query("""WITH s AS (SELECT 'k' || p_partkey % 500 AS skill, p_size % 4 AS tier, p_partkey % 13 = 0 AS no_names, p_partkey % 17 = 0 AS no_usages FROM part)
SELECT skill || ': duplicate id' AS problem FROM s GROUP BY skill HAVING count(*) > 1 UNION ALL SELECT skill || ': bad tier' FROM s WHERE tier NOT IN (1, 2) UNION ALL SELECT skill || ': bad applies.algorithms' FROM s WHERE no_names UNION ALL SELECT skill || ': bad applies.usages' FROM s WHERE no_usages""")
def knowledge_registry_problems(spark, d):
    p, one = F.col("p_partkey"), F.array(F.lit("RSA"))
    rows = load(spark, d, "part").select(codebase.filled("k{k}", k=p % 500).alias("skill"), (F.col("p_size") % 4).cast("int").alias("tier"), F.when(p % 13 != 0, one).alias("algorithms"), one.alias("scanners"), one.alias("categories"), F.when(p % 17 != 0, one).alias("usages"))
    return relate.registry_problems(rows)


# Code beside code: manifests, scripts and what the project as a whole shows


@query("SELECT array_to_string(list_sort(list(DISTINCT CASE doc_id % 9 WHEN 0 THEN 'requirements.txt' ELSE 'pyproject.toml' END)), ', ') AS files FROM documents WHERE doc_id % 9 IN (0, 2) HAVING count(DISTINCT doc_id % 9) = 2")
def code_overlapping_configs(spark, d):
    return structure.overlapping_configs(codebase.declared(spark, d))


def _said(template: str, **values: str) -> str:
    """A template of a file as SQL, with expressions in place of {names}."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [listed([head])[1:-1], f"({values[name]})"]
    return " || ".join([*out, listed([rest])[1:-1]])


def _block(when: str, template: str, **values: str) -> str:
    return f"CASE WHEN {when} THEN {_said(template, **values)} ELSE '' END"


#: Calls at the end of each script of the project, and its text in the SQL, by the names that `lifecycle.PARTS` lists.
CALLS = "JSON.parse(fetch('u_{i}'));\n"
_PY = {"i": "i", "t": "t", "u": "i - 1", "k": "i % 10", "w": "w", "back": "CASE WHEN i % 2 = 0 THEN 'os.name' ELSE '1' END"}
_BLOCKS = [("i % 5 = 0", "x_{i} = _hidden_{i}()\n"), ("i % 4 = 1", codebase.LOOPS), ("i % 6 = 1", codebase.ROUTE), ("i % 6 = 3", codebase.TEST), ("i % 50 = 10", codebase.BUSY), ("i % 7 = 0", codebase.MAIN)]
_JS = ["const ", "n[1]", " = use(", "n[6]", ", '", "n[2]", " // no comment');\nfunction ", "n[2]", "(x) {\n  return ", "n[5]", ";\n}\n/* f_", "n[3][3:]", "\n ", "n[1]", " */ export class ", "n[3]", " { }\n// ", "n[1]", "\nlet ", "n[4]", " = `", "n[1]", "\n`;\n"]
_JS_SQL = " || ".join([*[x if k % 2 else listed([x])[1:-1] for k, x in enumerate(_JS)], _said(CALLS, i="regexp_extract(path, '[0-9]+')")])
_SCRIPTS = lifecycle.PARTS.replace("WITH w AS", "sw AS", 1).replace("FROM w)", "FROM sw)", 1).replace("\nd AS", "\nsd AS", 1).replace("FROM d)", "FROM sd)", 1).rstrip()
#: The whole analysis: Python files as `codebase.FOUND`, scripts, blocks of lines that repeat in either, and what the project as a whole shows.
PROJECT = codebase.FOUND.rstrip() + codebase.M.replace("WITH m AS", ",\nm AS", 1).rstrip() + ",\n" + _SCRIPTS + f""",
tk AS MATERIALIZED (SELECT s.t AS name, path, count(*) AS n FROM said GROUP BY ALL), many AS (SELECT name FROM tk GROUP BY name HAVING count(*) > 1),
o AS (SELECT path, unnest([{{'name': n[1], 'line': 1}}, {{'name': n[2], 'line': 2}}, {{'name': n[4], 'line': 8}}], recursive := true) FROM sd),
spare AS (SELECT o.path, o.line, o.name FROM o JOIN tk ON o.name = tk.name AND o.path = tk.path WHERE tk.n = 1 AND o.name NOT IN (SELECT name FROM many)),
texts AS MATERIALIZED (SELECT path AS doc_id, {" || ".join([_said(codebase.BASE, **_PY), *[_block(when, text, **_PY) for when, text in _BLOCKS]])} AS text FROM b UNION ALL SELECT path, {_JS_SQL} FROM sd),
""" + lifecycle.COVERED.replace("WITH w AS MATERIALIZED", "w AS MATERIALIZED", 1).replace("FROM documents", "FROM texts").replace("\nSELECT c.* FROM c", ",\nblocks AS (SELECT c.* FROM c") + """)
SELECT path, line, name, category, title, confidence, score, label FROM a
UNION ALL SELECT path, line, name, 'DEAD_CODE', 'Potentially unused symbol `' || name || '`', 'LOW', 0.5, 'REQUIRES_REVIEW' FROM spare
UNION ALL SELECT path, 10, name, 'EFFICIENCY', 'Potentially repeated `' || name || '` (line 10)', 'LOW', 1.0, 'REQUIRES_REVIEW' FROM sd, (VALUES ('JSON.parse'), ('fetch')) AS x(name)
UNION ALL SELECT path, start, '', 'DUPLICATION', CASE WHEN key LIKE 'near%' THEN 'Near-duplicate' ELSE 'Duplicate' END || ' block (' || occurrences || '×, ~' || width || ' lines)', CASE WHEN files > 1 AND key LIKE 'exact%' THEN 'MEDIUM' ELSE 'LOW' END,
  CASE WHEN files = 1 THEN 0.25 WHEN key LIKE 'exact%' THEN 1.0 ELSE 0.5 END, 'REQUIRES_REVIEW' FROM blocks
UNION ALL SELECT path, 0, name, 'DEPENDENCY', 'Possibly unused dependency `' || name || '`', 'LOW', 0.5, 'REQUIRES_REVIEW' FROM d
UNION ALL SELECT path, 0, string_split(string_split(path, '/')[-1], '.')[1], 'STRUCTURE', 'Possibly orphaned module `' || path || '`', 'LOW', 0.5, 'REQUIRES_REVIEW' FROM lone
UNION ALL SELECT 'pyproject.toml', 0, '', 'CONFIGURATION', 'Overlapping configuration: pyproject.toml, requirements.txt', 'MEDIUM', 2.0, 'LOW_RISK'"""


@query(PROJECT)
def code_project(spark, d):
    """The whole analysis of a project of Python files, scripts and manifests, without limits."""
    calls = codebase.filled(CALLS, i=F.regexp_extract("path", "[0-9]+", 0))
    scripts = lifecycle._scripts(spark, d).select("path", F.concat("text", calls).alias("text"))
    declared = codebase.declared(spark, d)
    texts = kept(codebase.project(spark, d).unionByName(scripts).unionByName(declared), "texts")  # six analyzers read them
    found = code.analyse(codebase.facts(spark, d), texts, manifests.declared_packages(declared), None, None)
    return found.select("path", "line", "name", "category", "title", "confidence", "score", "label")


@query(lifecycle.PARTS + "SELECT path, unnest([{'kind': 'export', 'name': n[3]}, {'kind': 'def', 'name': n[1]}, {'kind': 'def', 'name': n[2]}, {'kind': 'def', 'name': n[3]}, {'kind': 'def', 'name': n[4]}], recursive := true) FROM d")
def javascript_facts(spark, d):
    return code.javascript_facts(lifecycle._scripts(spark, d))
