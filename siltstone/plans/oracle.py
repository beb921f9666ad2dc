"""The registered queries as SQL for DuckDB, written apart from the Column expressions."""

from __future__ import annotations

from siltstone.functions import rules

SYNTH = """
SELECT CAST(((l_orderkey * 8 + l_linenumber) * 20000000 + l_partkey) * 64 + CAST(l_quantity AS INT) % 64 AS BIGINT) AS ord, l_orderkey AS okey,
  CASE l_linenumber % 7 WHEN 0 THEN 'runtime' WHEN 1 THEN 'source' WHEN 2 THEN 'binary' WHEN 3 THEN 'container' WHEN 4 THEN 'dependency' WHEN 5 THEN 'hsm' ELSE 'cloud' END AS scanner,
  concat(CASE WHEN l_suppkey % 5 = 0 THEN 'a-b' ELSE 'a' END, '/m', CAST(l_suppkey % 10 AS VARCHAR), '/f', CAST(l_partkey % 48 AS VARCHAR), '.py') AS file_path,
  CAST(l_quantity AS INT) % 20 AS line,
  CASE l_partkey % 24 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' WHEN 2 THEN 'ECDH' WHEN 3 THEN 'DH' WHEN 4 THEN 'DSA' WHEN 5 THEN 'ECC' WHEN 6 THEN 'AES-128' WHEN 7 THEN 'AES-256'
    WHEN 8 THEN 'DES' WHEN 9 THEN '3DES' WHEN 10 THEN 'RC4' WHEN 11 THEN 'ChaCha20' WHEN 12 THEN 'MD5' WHEN 13 THEN 'SHA-1' WHEN 14 THEN 'SHA-256' WHEN 15 THEN 'SHA-384'
    WHEN 16 THEN 'HMAC' WHEN 17 THEN 'PBKDF2' WHEN 18 THEN 'TLS1.0' WHEN 19 THEN 'TLS1.2' WHEN 20 THEN 'PEM-CERTIFICATE' WHEN 21 THEN 'KEYSIZE' WHEN 22 THEN 'OpenSSL' ELSE 'KMS' END AS algorithm,
  CASE WHEN l_partkey % 24 < 6 THEN 'asymmetric' WHEN l_partkey % 24 < 12 THEN 'symmetric' WHEN l_partkey % 24 < 18 THEN 'hash' WHEN l_partkey % 24 < 20 THEN 'protocol'
    WHEN l_partkey % 24 = 20 THEN 'certificate' WHEN l_partkey % 24 = 22 THEN 'library' ELSE 'key' END AS category,
  CASE WHEN l_partkey % 24 = 0 THEN CASE l_orderkey % 5 WHEN 0 THEN 1024 WHEN 1 THEN 2048 WHEN 2 THEN 3072 WHEN 3 THEN 4096 END WHEN l_partkey % 24 = 6 THEN 128 WHEN l_partkey % 24 = 7 THEN 256 END AS key_size,
  '' AS curve, CASE l_orderkey % 3 WHEN 0 THEN 'CBC' ELSE '' END AS mode, CASE WHEN l_suppkey % 3 = 0 THEN concat('lib', CAST(l_suppkey % 9 AS VARCHAR)) ELSE '' END AS library,
  CASE l_linenumber % 7 WHEN 0 THEN 'runtime observation' WHEN 1 THEN 'direct' WHEN 2 THEN 'binary string reference' WHEN 3 THEN 'container file reference'
    WHEN 4 THEN 'dependency reference' WHEN 5 THEN 'hsm integration reference' ELSE 'cloud crypto configuration' END AS usage,
  CAST(CASE l_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence
FROM lineitem"""


def base(name: str) -> str:
    return f"(CASE WHEN starts_with(upper({name}), 'AES') THEN 'AES' WHEN starts_with(upper({name}), 'RSA') THEN 'RSA' WHEN starts_with(upper({name}), 'TLS') THEN replace(upper({name}), '.', '') WHEN starts_with(upper({name}), 'SHA-2') THEN 'SHA-2' WHEN starts_with(upper({name}), 'PEM-') THEN 'PEM' ELSE upper({name}) END)"


def family(name: str) -> str:
    b = base(name)
    return f"(CASE WHEN regexp_full_match({b}, 'SHA[-_ ]?(224|256|384|512)') THEN 'SHA-2' WHEN starts_with({b}, 'HMAC') THEN 'HMAC' WHEN {b} IN ('PBKDF2', 'KDF') THEN 'KDF' WHEN starts_with({b}, 'TLS') THEN 'TLS' ELSE {b} END)"


def names(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


RECOMMEND = "(VALUES " + ", ".join(names(x) for x in rules.RECOMMENDATIONS.items()) + ") AS r(k, recommend)"


def assessed(source: str, horizon: tuple[float, float, float] = (10, 3, 10)) -> str:
    """SQL of the columns that enrich() adds, over a relation of findings."""
    out = "TRUE" if horizon[0] + horizon[1] > horizon[2] else "FALSE"
    qv, weak, exempt = names(rules.QUANTUM_VULNERABLE), names(rules.WEAK), names(rules.EXEMPT)
    return f"""SELECT *, CASE WHEN severity IN ('critical', 'high') OR priority IN ('P0', 'P1') THEN 'MIGRATION_REQUIRED' WHEN severity = 'medium' OR priority = 'P2' THEN 'MIGRATION_PLANNED' ELSE 'DISCOVERED' END AS status,
      CASE WHEN priority = 'P0' OR severity = 'critical' THEN 'Immediate' WHEN priority = 'P1' OR severity = 'high' THEN 'Near-term' WHEN priority = 'P2' OR severity = 'medium' THEN 'Planned' ELSE 'Monitor' END AS bucket,
      coalesce((SELECT recommend FROM {RECOMMEND} WHERE k = base), '{rules.NO_RECOMMENDATION}') AS recommend
    FROM (SELECT *, CASE WHEN priority_score >= 90 THEN 'P0' WHEN priority_score >= 65 THEN 'P1' WHEN priority_score >= 30 THEN 'P2' ELSE 'P3' END AS priority FROM (
      SELECT *, CASE WHEN base IN {qv} THEN CASE WHEN exposed OR (base = 'RSA' AND key_size < 2048) THEN 'critical' ELSE 'high' END WHEN base IN {weak} THEN CASE WHEN exposed THEN 'high' ELSE 'medium' END WHEN exposed THEN 'medium' ELSE 'low' END AS severity,
        least(100, CASE WHEN base IN {weak} THEN 70 ELSE 0 END + CASE WHEN base IN {qv} THEN 45 ELSE 0 END + CASE WHEN base = 'RSA' AND key_size <> 0 AND key_size < 2048 THEN 35 ELSE 0 END
          + CASE WHEN base IN ('SSL', 'TLS10', 'TLS11') THEN 20 ELSE 0 END + CASE WHEN exposed THEN 25 ELSE 0 END) AS priority_score,
        CASE WHEN usage IN {names(rules.STRONG_USAGES)} THEN 'HIGH' WHEN usage = 'binary string reference' OR confidence < 0.6 THEN 'LOW' WHEN usage = 'direct' AND confidence >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS strength,
        left(sha1(concat_ws('|', scanner, file_path, line::VARCHAR, algorithm, category, coalesce(key_size::VARCHAR, 'None'), curve, usage)), 12) AS id,
        'f' || left(sha1(concat_ws('|', scanner, file_path, algorithm, category, coalesce(key_size::VARCHAR, 'None'), curve, usage)), 11) AS fp
      FROM (SELECT *, {out} AND base NOT IN {exempt} AS exposed FROM (SELECT *, {base('algorithm')} AS base, {family('algorithm')} AS family FROM ({source}) s0) s1) s2) s3) s4"""


E_ = f"WITH e AS MATERIALIZED ({assessed(SYNTH)}) "
SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 3 END"
PRI = "CASE priority WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 ELSE 3 END"
BUCKET = "CASE bucket WHEN 'Immediate' THEN 0 WHEN 'Near-term' THEN 1 WHEN 'Planned' THEN 2 ELSE 3 END"
STATUS = "CASE status WHEN 'MIGRATION_REQUIRED' THEN 0 WHEN 'MIGRATION_PLANNED' THEN 1 ELSE 4 END"
REC = f"coalesce((SELECT recommend FROM {RECOMMEND} WHERE k = family), '{rules.NO_RECOMMENDATION}')"
DISPLAY = "CASE " + " ".join(f"WHEN starts_with(upper(algorithm), '{b}') THEN '{f}'" for b, f in [("AES", "AES"), ("RSA", "RSA"), ("ECDSA", "ECDSA"), ("ECDH", "ECDH"), ("EC_", "ECC"), ("DH", "DH"), ("DSA", "DSA"), ("MD5", "MD5"), ("SHA3", "SHA-3"), ("SHA2", "SHA-2"), ("SHA1", "SHA-1"), ("SHA", "SHA"), ("HMAC", "HMAC"), ("TLS", "TLS/SSL"), ("SSL", "TLS/SSL")]) + " ELSE upper(algorithm) END"


def re2(pattern: str) -> str:
    """The pattern without look-around, for boolean tests: what may not stand beside it becomes a consumed border."""
    p = pattern.replace("(?<![A-Za-z0-9])", "(^|[^A-Za-z0-9])").replace("(?![A-Za-z0-9])", "($|[^A-Za-z0-9])").replace("(?!.*256)", "")
    return "(?i)" + p


LINE_TABLE = "(VALUES " + ", ".join(f"({k}, '{re2(p).replace(chr(39), chr(39) * 2)}', '{a}', '{c}', {conf}::DOUBLE)" for k, (p, a, c, conf, _) in enumerate(rules.LINE_RULES, 1)) + ") AS rule(n, p, algorithm, category, confidence)"
SECRET_SQL = ("(?i)" + rules.SECRET).replace("'", "''")


def line_hits(table: str, key: str, text: str, more: str = "") -> str:
    return f"""WITH l AS (SELECT {key} AS key{more}, unnest(string_split({text}, chr(10))) AS content, generate_subscripts(string_split({text}, chr(10)), 1) AS line FROM {table})
    SELECT key{more and ', ' + more.strip(', ').split()[-1]}, CAST(line AS INT) AS line, algorithm, category, confidence,
      left(regexp_replace(regexp_replace(content, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '{SECRET_SQL}', '\\1\\2[REDACTED]', 'g'), 160) AS evidence
    FROM l, {LINE_TABLE} WHERE regexp_matches(content, p) AND NOT (n = 14 AND regexp_matches(content, '(?i)\\bSHA[-_ ]?1\\b.*256'))"""


SUPPORTS = """st AS (SELECT family, id AS support_id, row_number() OVER (PARTITION BY family ORDER BY ord) AS place FROM e WHERE scanner <> 'runtime'),
 sup AS (SELECT e.id, e.ord, support_id, place FROM e JOIN st USING (family) WHERE scanner = 'runtime' AND place <= 5)"""

RELATED = SUPPORTS + """,
 c AS (SELECT x.ord, x.id, y.id AS target, y.ord AS t, 0 AS p, 'same-artifact' AS relation FROM e x JOIN (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ord) AS n FROM (SELECT file_path, id, min(ord) AS ord FROM e GROUP BY ALL)) y ON x.file_path = y.file_path AND y.n <= 40
  UNION ALL SELECT x.ord, x.id, y.id, y.ord, 1, 'same-library' FROM e x JOIN (SELECT *, row_number() OVER (PARTITION BY library ORDER BY ord) AS n FROM (SELECT library, id, min(ord) AS ord FROM e WHERE library <> '' GROUP BY ALL)) y ON x.library = y.library AND y.n <= 40
  UNION ALL SELECT x.ord, x.id, s.id, min(s.ord), 2, 'runtime-observed' FROM e x JOIN (SELECT support_id, id, min(ord) AS ord FROM sup GROUP BY ALL) s ON x.id = s.support_id GROUP BY x.ord, x.id, s.id
  UNION ALL SELECT x.ord, x.id, y.id, y.ord, 3, 'same-family' FROM e x JOIN (SELECT *, row_number() OVER (PARTITION BY family, scanner ORDER BY ord) AS n FROM (SELECT family, scanner, id, min(ord) AS ord FROM e GROUP BY ALL)) y ON x.family = y.family AND x.scanner <> y.scanner AND y.n <= 24),
 b AS (SELECT ord, id, target, min((p, t, relation)) AS b FROM c WHERE target <> id GROUP BY ord, id, target),
 rel AS (SELECT ord, id, target, b[3] AS relation, row_number() OVER (PARTITION BY ord ORDER BY b[1], b[2], target) AS place FROM b)"""
RELATED = RELATED.replace("min((p, t, relation)) AS b", "min({'p': p, 't': t, 'r': relation}) AS b").replace("b[3]", "b.r").replace("b[1]", "b.p").replace("b[2]", "b.t")


def skill_rows() -> str:
    arr = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]::VARCHAR[]"
    return "(VALUES " + ", ".join(f"({k}, '{s}', {t}, {arr(a)}, {arr(sc)}, {arr(c)}, {arr(u)})" for k, (s, t, a, sc, c, u) in enumerate(rules.SKILLS)) + ") AS s(k, skill, tier, algos, scanners, categories, usages)"


KNOWLEDGE = f"""m AS (SELECT ord, id, skill, hit, row_number() OVER (PARTITION BY ord ORDER BY CASE WHEN hit THEN k ELSE 1000000 + tier * 10000 + greatest(1, len(scanners)) * 100 + k END) AS place FROM (
   SELECT ord, id, scanner, category, usage, s.*, list_has_any([upper(algorithm), base, family], algos) AS hit FROM e, {skill_rows()}) x
  WHERE (len(algos) = 0 OR hit OR skill = 'crypto-audit') AND (list_contains(scanners, scanner) OR (category = 'dependency' AND list_contains(scanners, 'dependency'))) AND list_contains(categories, category) AND (len(usages) = 0 OR list_contains(usages, usage)))"""

RESULTS = """v AS (SELECT id AS finding_id, CASE ord % 5 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'PARTIALLY_CONFIRMED' WHEN 2 THEN 'OBSERVED' WHEN 3 THEN 'NOT_APPLICABLE' ELSE 'FAILED' END AS v_status, 'tls' AS validation_type, algorithm AS observed_algorithm FROM e WHERE ord % 11 = 0
   UNION ALL SELECT '', 'OBSERVED', 'runtime', algorithm FROM e WHERE scanner = 'runtime' AND ord % 3 = 0 AND algorithm IN ('RSA', 'MD5', 'SHA-256')
   UNION ALL SELECT '', 'OBSERVED', 'runtime', 'ML-KEM' FROM e WHERE okey = 0)"""

BEFORE, AFTER = assessed(f"SELECT * FROM ({SYNTH}) WHERE okey % 10 <> 0", (1, 1, 10)), assessed(f"SELECT * REPLACE (CASE WHEN okey % 7 = 0 THEN line + 100 ELSE line END AS line) FROM ({SYNTH}) WHERE okey % 10 <> 1")
LEVEL = "list_position(['low', 'medium', 'high', 'critical'], {})"
DELTA = f"""WITH b0 AS MATERIALIZED ({BEFORE}), a0 AS MATERIALIZED ({AFTER}),
 b AS (SELECT id, arg_max(fp, ord) AS fp, arg_max(severity, ord) AS severity, min(ord) AS o FROM b0 GROUP BY id), a AS (SELECT id, arg_max(fp, ord) AS fp, arg_max(severity, ord) AS severity, min(ord) AS o FROM a0 GROUP BY id),
 gone AS (SELECT id, fp, severity, row_number() OVER (PARTITION BY fp ORDER BY id) AS n FROM b WHERE id NOT IN (SELECT id FROM a)),
 cand AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY k, o) AS n FROM (SELECT b.fp, b.id, a.severity, 0 AS k, b.o FROM b JOIN a USING (id) UNION ALL SELECT fp, id, severity, 1, o FROM a WHERE id NOT IN (SELECT id FROM b))),
 pair AS (SELECT g.id, c.id AS after_id, g.severity AS before_severity, c.severity AS after_severity FROM gone g JOIN cand c USING (fp, n)),
 d AS (SELECT 'changed' AS change, * FROM pair UNION ALL SELECT 'resolved', id, NULL, severity, NULL FROM gone WHERE id NOT IN (SELECT id FROM pair)
  UNION ALL SELECT 'new', id, NULL, NULL, severity FROM a WHERE id NOT IN (SELECT id FROM b) AND id NOT IN (SELECT after_id FROM pair)
  UNION ALL SELECT 'unchanged', b.id, NULL, b.severity, a.severity FROM b JOIN a USING (id)) """

EDGES = RELATED + """, ed AS (SELECT DISTINCT * FROM (SELECT 'artifact:' || file_path AS source, id AS target, 'contains' AS relation FROM e UNION ALL SELECT id, 'family:' || family, 'instance-of' FROM e
  UNION ALL SELECT id, 'library:' || library, 'uses' FROM e WHERE library <> '' UNION ALL SELECT id, target, relation FROM rel WHERE place <= 8))"""
WINDOWS = """WITH w AS (SELECT doc_id, s AS start, {w} AS width, list_aggregate([{body} FOR x IN lines[s:s + {w} - 1] IF {keep}], 'string_agg', chr(10)) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d, unnest(range(1, greatest(len(lines) - {w} + 2, 1))) AS t(s) WHERE len(lines) >= {w})
 SELECT doc_id::VARCHAR AS path, CAST(start AS INT) AS start, CAST(width AS INT) AS width, '{kind}' || left(sha1(body), 16) AS key FROM w WHERE length(body) - length(replace(body, chr(10), '')) + 1 >= 6"""
STRIPPED = "regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')"
KEPT = f"{STRIPPED} <> '' AND NOT regexp_matches({STRIPPED}, '^(#|//)')"
MASKED = f"regexp_replace(regexp_replace({STRIPPED}, '\\b0x[0-9a-fA-F]+\\b|\\b\\d+(\\.\\d+)?\\b', '<NUM>', 'g'), '\"[^\"]*\"|''[^'']*''', '<STR>', 'g')"
STRATEGY = f"""CASE WHEN usage = 'dependency integrity metadata' THEN 'none' WHEN category IN ('certificate', 'protocol') OR (base IN {names(rules.TLS_NAMES)} AND category IN ('certificate', 'protocol', 'key')) THEN 'tls'
 WHEN category IN ('library', 'symmetric', 'asymmetric', 'hash') AND base NOT IN ('UNKNOWN', '') THEN 'runtime' WHEN category = 'dependency' THEN 'runtime' ELSE 'none' END"""
SCORE = "(CASE WHEN contains(lower(doc_id::VARCHAR), 'the') THEN 3 ELSE 0 END + CASE WHEN contains(lower(doc_id::VARCHAR), 'tion') THEN 3 ELSE 0 END + (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4)::BIGINT"
SEARCH = f"""SELECT {SCORE} AS score, doc_id::VARCHAR AS path, left(regexp_replace(coalesce([x FOR x IN string_split(text, chr(10)) IF contains(lower(x), 'the') OR contains(lower(x), 'tion')][1], ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), 160) AS snippet
 FROM documents WHERE {SCORE} > 0 ORDER BY score DESC, path DESC, snippet DESC LIMIT 20"""
TRIAGE = "t AS (SELECT fp, ['open', 'triaged', 'planned', 'in_progress', 'fixed', 'verified', 'suppressed'][('0x' || fp[2:5])::INT % 7 + 1] AS triage FROM (SELECT DISTINCT fp FROM e WHERE scanner = 'hsm'))"

ORACLES = {
    "line_rule_hits": line_hits("documents", "doc_id::VARCHAR", "text"),
    "line_rule_counts_by_lang": f"SELECT lang, algorithm, count(*) AS n FROM ({line_hits('documents', 'doc_id::VARCHAR', 'text', ', lang')}) GROUP BY ALL",
    "page_rule_hits": line_hits("pages", "page_id::VARCHAR", "html"),
    "conversation_rule_hits": line_hits("conversations", "concat_ws('/', conv_id, turn)", "text"),
    "redacted_evidence": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, CAST(line AS INT) AS line, left(regexp_replace(regexp_replace(content, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '{SECRET_SQL}', '\\1\\2[REDACTED]', 'g'), 160) AS evidence FROM l WHERE regexp_matches(content, '{SECRET_SQL}')",
    "findings_dedupe": f"SELECT ord, scanner, file_path, line, algorithm, key_size, mode, library FROM (SELECT *, row_number() OVER (PARTITION BY scanner, file_path, line, algorithm, category, key_size, mode, library, curve, usage ORDER BY ord) AS n FROM ({SYNTH})) WHERE n = 1",
    "findings_ids": E_ + "SELECT ord, id, fp FROM e",
    "assess_scores": E_ + "SELECT ord, algorithm, exposed AS mosca_exposed, severity, CAST(priority_score AS INT) AS priority_score, priority FROM e",
    "risk_factor_tally": E_ + "SELECT factor, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{rules.FACTORS[k]}' AS factor FROM e WHERE {w}" for k, w in (("weak", f"base IN {names(rules.WEAK)}"), ("quantum", f"base IN {names(rules.QUANTUM_VULNERABLE)}"), ("short", "base = 'RSA' AND key_size < 2048"), ("legacy", "base IN ('SSL', 'TLS10', 'TLS11')"), ("exposed", "exposed"), ("none", "priority_score = 0"))) + ") GROUP BY factor",
    "severity_tally": E_ + "SELECT severity, count(*) AS n FROM e GROUP BY severity",
    "priority_tally": E_ + "SELECT priority, severity, count(*) AS n FROM e GROUP BY ALL",
    "recommend_join": E_ + "SELECT ord, algorithm, recommend FROM e",
    "recommendation_cards": E_ + f"SELECT recommend, count(*) AS n, arg_min(severity, {SEV}) AS severity, arg_min(priority, {PRI}) AS priority FROM e GROUP BY recommend",
    "inventory_by_family": E_ + f"SELECT family, count(*) AS findings, array_to_string(list_sort(list(DISTINCT algorithm)), ',') AS algorithms, array_to_string(list_sort(list(DISTINCT scanner)), ',') AS scanners, arg_min(severity, {SEV}) AS severity, arg_min(priority, {PRI}) AS priority, arg_min(strength, CASE strength WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS evidence, bool_or(scanner = 'runtime') AS runtime, count(DISTINCT file_path) AS artifacts, {REC} AS recommend FROM e GROUP BY family",
    "inventory_artifacts": E_ + "SELECT family, file_path FROM (SELECT family, file_path, row_number() OVER (PARTITION BY family ORDER BY file_path) AS n FROM (SELECT DISTINCT family, file_path FROM e)) WHERE n <= 50",
    "display_families": E_ + f"SELECT {DISPLAY} AS shown, count(*) AS n, count_if(severity IN ('critical', 'high')) AS critical_high, count_if(library <> '') AS with_library FROM e GROUP BY ALL",
    "correlate_supports": E_ + ", " + SUPPORTS + " SELECT ord, id, support_id, CAST(place AS INT) AS place FROM sup",
    "related_links": E_ + ", " + RELATED + " SELECT ord, id, target, relation, CAST(place AS INT) AS place FROM rel WHERE place <= 8",
    "related_counts_by_relation": E_ + ", " + RELATED + " SELECT relation, count(*) AS n FROM rel WHERE place <= 8 GROUP BY relation",
    "evidence_strength_tally": E_ + "SELECT strength, scanner, count(*) AS n FROM e GROUP BY ALL",
    "migration_work_items": E_ + f"SELECT left(sha1('migrate:' || family), 12) AS id, family, count(*) AS findings, first(priority ORDER BY {PRI}, {SEV}, ord) AS priority, first(severity ORDER BY {PRI}, {SEV}, ord) AS severity, first(ord ORDER BY {PRI}, {SEV}, ord) AS worst_ord, arg_min(status, {STATUS}) AS status, arg_min(bucket, {BUCKET}) AS bucket, bool_or(scanner = 'hsm') AS hsm, bool_or(scanner = 'cloud') AS cloud, bool_or(scanner = 'runtime') AS runtime, {REC} AS direction FROM e GROUP BY family",
    "migration_roadmap": E_ + f"SELECT bucket, count(*) AS items, array_to_string(list_sort(list(id)), ',') AS ids FROM (SELECT left(sha1('migrate:' || family), 12) AS id, arg_min(bucket, {BUCKET}) AS bucket FROM e GROUP BY family) GROUP BY bucket",
    "migration_status_counts": E_ + "SELECT status, count(*) AS n FROM e GROUP BY status",
    "knowledge_matches": E_ + ", " + KNOWLEDGE + " SELECT ord, id, skill, CASE WHEN hit THEN 'HIGH' ELSE 'MEDIUM' END AS strength, CAST(place AS INT) AS place FROM m WHERE place <= 5",
    "knowledge_coverage": E_ + ", " + KNOWLEDGE + " SELECT skill, count(*) AS n, count_if(hit) AS high FROM m WHERE place <= 5 GROUP BY skill",
    "strategy_map": E_ + f"SELECT {STRATEGY} AS strategy, algorithm, category, count(*) AS n FROM e GROUP BY ALL",
    "validation_rollup": E_ + ", " + RESULTS + """, own AS (SELECT finding_id, bool_or(v_status = 'CONFIRMED') AS c, bool_or(v_status = 'PARTIALLY_CONFIRMED') AS p, bool_or(v_status = 'OBSERVED') AS o, bool_and(v_status = 'NOT_APPLICABLE') AS n FROM v WHERE finding_id <> '' GROUP BY finding_id),
 seen AS (SELECT DISTINCT """ + family("observed_algorithm") + """ AS family FROM v WHERE validation_type = 'runtime')
 SELECT ord, id, CASE WHEN own.c IS NULL THEN CASE WHEN seen.family IS NOT NULL THEN 'RUNTIME_OBSERVED' WHEN usage = 'dependency integrity metadata' THEN 'NOT_APPLICABLE' ELSE 'STATIC_ONLY' END WHEN c THEN 'RUNTIME_CONFIRMED' WHEN p THEN 'RUNTIME_CORRELATED' WHEN o THEN 'RUNTIME_OBSERVED' WHEN n THEN 'NOT_APPLICABLE' ELSE 'STATIC_ONLY' END AS validation_status
 FROM e LEFT JOIN own ON e.id = own.finding_id LEFT JOIN seen ON e.family = seen.family""",
    "unrelated_observations": E_ + ", " + RESULTS + " SELECT observed_algorithm, count(*) AS n FROM v WHERE validation_type = 'runtime' AND " + family("observed_algorithm") + " NOT IN (SELECT family FROM e) GROUP BY ALL",
    "delta_rows": DELTA + "SELECT * FROM d",
    "delta_summary": DELTA + "SELECT change, count(*) AS n, count_if(coalesce(before_severity, '') = 'critical' OR coalesce(after_severity, '') = 'critical') AS critical FROM d GROUP BY change",
    "severity_regressions": DELTA + f"SELECT id, after_id, before_severity, after_severity FROM d WHERE change IN ('unchanged', 'changed') AND {LEVEL.format('after_severity')} > {LEVEL.format('before_severity')}",
    "verify_status": DELTA + f", n AS (SELECT id, bool_or(file_path IN {names(['a/m1/f1.py', 'a/m3/f7.py', 'a-b/m0/f4.py'])}) AS t FROM a0 WHERE id NOT IN (SELECT id FROM b) GROUP BY id) SELECT 'REMAINS' AS status, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS resolved, (SELECT count(*) FROM b WHERE id IN (SELECT id FROM a)) AS remains, (SELECT count(*) FROM n WHERE t) AS regressions, (SELECT count(*) FROM n WHERE NOT t) AS unrelated_new",
    "verify_status_replaced": DELTA + "SELECT 'REGRESSION' AS status, (SELECT count(*) FROM b) AS resolved, 0::BIGINT AS remains, (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS regressions, 0::BIGINT AS unrelated_new",
    "set_difference": DELTA + "SELECT id FROM b EXCEPT SELECT id FROM a",
    "set_intersection": DELTA + "SELECT id FROM b INTERSECT SELECT id FROM a",
    "triage_overlay": E_ + ", " + TRIAGE + " SELECT ord, e.fp, coalesce(triage, 'open') AS triage FROM e LEFT JOIN t USING (fp)",
    "triage_listing": "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 500",
    "findings_filter_text": E_ + "SELECT ord, id, file_path, algorithm FROM e WHERE priority = 'P0' AND contains(lower(concat_ws(' ', algorithm, library, file_path, usage, scanner, category, severity, priority, family)), 'lib3')",
    "findings_report_order": E_ + "SELECT CAST(row_number() OVER (ORDER BY priority_score DESC, file_path, line, algorithm, ord) AS BIGINT) AS place, ord, priority_score::INT AS priority_score, file_path, line, algorithm FROM e",
    "top_findings": E_ + f"SELECT id, priority, algorithm FROM e ORDER BY {PRI}, id, ord LIMIT 5",
    "usage_graph_edges": E_ + ", " + EDGES + " SELECT * FROM ed",
    "usage_graph_nodes": E_ + "SELECT 'artifact:' || file_path AS node, 'artifact' AS type FROM e UNION SELECT id, 'finding' FROM e UNION SELECT 'family:' || family, 'family' FROM e UNION SELECT 'library:' || library, 'library' FROM e WHERE library <> ''",
    "graph_degree": E_ + ", " + EDGES + " SELECT node, count(*) AS degree FROM (SELECT source AS node FROM ed UNION ALL SELECT target FROM ed) GROUP BY node",
    "graph_health": "SELECT * FROM (VALUES ('duplicate', 0::BIGINT), ('dangling', 0::BIGINT)) AS t(problem, n)",
    "graph_diff": DELTA + "SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(a.id, b.id) AS id FROM b FULL JOIN a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.severity <> b.severity",
    "blast_radius": E_ + ", " + EDGES + " SELECT node, arg_min(relation, CASE relation WHEN 'contains' THEN 0 WHEN 'same-artifact' THEN 1 WHEN 'uses' THEN 2 WHEN 'instance-of' THEN 3 WHEN 'same-library' THEN 4 WHEN 'runtime-observed' THEN 5 ELSE 6 END) AS bucket FROM (SELECT target AS node, relation FROM ed WHERE source = 'library:lib3' UNION ALL SELECT source, relation FROM ed WHERE target = 'library:lib3') GROUP BY node",
    "path_directories": E_ + "SELECT DISTINCT CASE WHEN i = 1 THEN '' ELSE array_to_string(string_split(file_path, '/')[:i - 1], '/') END AS parent, array_to_string(string_split(file_path, '/')[:i], '/') AS child FROM (SELECT DISTINCT file_path FROM e), unnest(range(1, 4)) AS t(i)",
    "keyword_search": SEARCH,
    "budgeted_context": f"""WITH s AS ({SEARCH}), w AS (SELECT row_number() OVER (ORDER BY score DESC, path DESC)::INT AS place, path, concat(chr(10), '## ', path, chr(10), left(text, 1500), chr(10)) AS whole
 FROM s JOIN documents ON path = doc_id::VARCHAR), r AS (SELECT *, 4000 - length('# Task' || chr(10) || 'The tion' || chr(10)) - coalesce(sum(length(whole)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget FROM w)
 SELECT place, path, left(whole, CAST(budget AS BIGINT)) AS chunk FROM r WHERE budget > 0""",
    "history_index": "SELECT user_id, count(*) AS scans, max(event_id) AS latest FROM events GROUP BY user_id",
    "retention_newest_n": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 500",
    "previous_scan": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events",
    "telemetry_parse": "SELECT event_id, event_type AS lib, json_extract_string(props, '$.k') AS algo FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "duplicate_windows_exact": " UNION ALL ".join(f"({WINDOWS.format(w=w, body=STRIPPED, keep=KEPT, kind='exact')})" for w in (12, 8, 6)),
    "duplicate_windows_masked": " UNION ALL ".join(f"({WINDOWS.format(w=w, body=MASKED, keep=KEPT, kind='near')})" for w in (12, 8, 6)),
    "sarif_rules": E_ + "SELECT algorithm AS rule, arg_min(severity, ord) AS severity FROM e GROUP BY algorithm",
    "sarif_results": E_ + "SELECT ord, algorithm AS rule, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, file_path AS uri, greatest(1, line)::INT AS line FROM e",
    "cbom_summary": E_ + "SELECT count(*) AS total, count_if(exposed) AS exposed, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low, array_to_string(list_sort(list(DISTINCT algorithm)), ',') AS algorithms FROM e",
    "gate_critical": E_ + "SELECT count_if(severity = 'critical') > 0 AS failing, count_if(severity = 'critical') AS n FROM e",
    "findings_flagged": E_ + f"SELECT ord, algorithm, status FROM e WHERE family IN {names(rules.QUANTUM_VULNERABLE)} AND status = 'MIGRATION_REQUIRED'",
    "inventory_cross_linked": E_ + "SELECT family, count(*) AS findings, bool_or(scanner = 'runtime') AS runtime FROM e GROUP BY family HAVING count(*) > 1 OR bool_or(scanner = 'runtime')",
    "scan_counts": E_ + "SELECT CAST(okey % 4 AS VARCHAR) AS scan_id, count(*) AS crypto, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(scanner = 'hsm' AND okey % 4 < 3) AS code, count(*) + count_if(scanner = 'hsm' AND okey % 4 < 3) AS total FROM e GROUP BY okey % 4",
    "relativized_findings": f"WITH e AS MATERIALIZED ({assessed('SELECT * REPLACE (CASE okey % 3 WHEN 0 THEN concat(chr(47), chr(119), chr(47), file_path) WHEN 1 THEN concat(chr(47), chr(101), chr(108), chr(115), chr(101), chr(47), file_path) ELSE file_path END AS file_path) FROM (' + SYNTH + ')')}), n AS (SELECT *, id AS old_id, CASE okey % 3 WHEN 0 THEN 'o/r@c/' || substr(file_path, 4) WHEN 1 THEN file_path ELSE 'o/r@c/' || file_path END AS p FROM e) "
        "SELECT ord, p AS file_path, left(sha1(concat_ws('|', scanner, p, line::VARCHAR, algorithm, category, coalesce(key_size::VARCHAR, 'None'), curve, usage)), 12) AS id, 'f' || left(sha1(concat_ws('|', scanner, p, algorithm, category, coalesce(key_size::VARCHAR, 'None'), curve, usage)), 11) AS fp, old_id FROM n",
    "knowledge_by_direction": E_ + ", " + KNOWLEDGE + ", f AS (SELECT recommend AS direction, skill, min({'o': ord, 'p': place}) AS first FROM m JOIN e USING (ord) WHERE place <= 5 GROUP BY ALL) SELECT direction, string_agg(skill, ',' ORDER BY first.o, first.p, skill) AS skills FROM f GROUP BY direction",
    "page_paths": "SELECT page_id, CASE WHEN len(string_split(u, '/')) <= 3 THEN u ELSE '.../' || array_to_string(string_split(u, '/')[-3:], '/') END AS shown FROM (SELECT page_id, split_part(url, '?', 1) AS u FROM pages)",
}

ORACLES |= {
    "gate_observed": E_ + ", " + RESULTS + """, own AS (SELECT finding_id, bool_or(v_status = 'CONFIRMED') AS c, bool_or(v_status = 'PARTIALLY_CONFIRMED') AS p, bool_or(v_status = 'OBSERVED') AS o FROM v WHERE finding_id <> '' GROUP BY finding_id),
 seen AS (SELECT DISTINCT """ + family("observed_algorithm") + """ AS family FROM v WHERE validation_type = 'runtime')
 SELECT count(*) FILTER (hit) > 0 AS failing, count(*) FILTER (hit) AS n FROM (SELECT CASE WHEN own.c IS NULL THEN seen.family IS NOT NULL ELSE c OR p OR o END AS hit FROM e LEFT JOIN own ON e.id = own.finding_id LEFT JOIN seen ON e.family = seen.family)""",
    "relativized_links": f"WITH e AS MATERIALIZED ({assessed('SELECT * REPLACE (concat(chr(47), chr(119), chr(47), file_path) AS file_path) FROM (' + SYNTH + ') WHERE okey < 40')}), " + SUPPORTS
        + ", n AS (SELECT DISTINCT id AS old, left(sha1(concat_ws('|', scanner, 'o/r@c/' || substr(file_path, 4), line::VARCHAR, algorithm, category, coalesce(key_size::VARCHAR, 'None'), curve, usage)), 12) AS new FROM e)"
        " SELECT ord, a.new AS id, b.new AS support_id FROM sup JOIN n a ON a.old = sup.id JOIN n b ON b.old = sup.support_id",
    "sarif_json": E_ + """SELECT ord, '{"ruleId":"' || algorithm || '","level":"' || CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END || '","message":{"text":""},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file_path
      || '"},"region":{"startLine":' || greatest(1, line) || '}}}],"properties":{"findingId":"' || id || '","validations":[]}}' AS json FROM e""",
    "cbom_document": E_ + f"""SELECT '{{"summary":{{"total":' || count(*) || ',"exposed":' || count(*) FILTER (exposed) || ',"critical":' || count(*) FILTER (severity = 'critical') || ',"high":' || count(*) FILTER (severity = 'high') || ',"medium":' || count(*) FILTER (severity = 'medium') || ',"low":' || count(*) FILTER (severity = 'low')
      || ',"algorithms":"' || array_to_string(list_sort(list(DISTINCT algorithm)), ',') || '"}},"recommendations":[' || (SELECT string_agg('"' || recommend || '"', ',' ORDER BY first) FROM (SELECT recommend, min(ord) AS first FROM e GROUP BY recommend)) || '],"inventory":['
      || (SELECT string_agg('{{"family":"' || family || '","findings":' || n || ',"severity":"' || severity || '","priority":"' || priority || '"}}', ',' ORDER BY family) FROM (SELECT family, count(*) AS n, arg_min(severity, {SEV}) AS severity, arg_min(priority, {PRI}) AS priority FROM e GROUP BY family)) || ']}}' AS json FROM e""",
}
