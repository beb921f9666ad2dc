"""Operators on small literal rows; registered queries against DuckDB."""

import os

import duckdb
import literal_inputs
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.operators import code, delta, detect, duplication, graph, score
from siltstone.plans import report
from siltstone.sources import files
from siltstone.sources.tables import lines
from siltstone.streaming import telemetry

SF = "/root/testdata/sf0.001"
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, sql = entry.queries()[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = sorted((repr([cell(r[c]) for c in columns]) for r in df.collect()))
    at = [sql.columns.index(c) for c in columns]
    assert rows == sorted(repr([cell(r[i]) for i in at]) for r in sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def hits(spark, *texts, name="app/x.py"):
    rows = spark.createDataFrame([(name, i, t) for i, t in enumerate(texts, 1)], "key string, line int, content string")
    return {(r.line, r.algorithm, r.category, r.key_size) for r in detect.line_findings(rows).collect()}


def test_line_rules(spark):
    assert hits(spark, "AES_256", "rsa 1024", "f.key_size", "if x.key_size:", "key_size: 4096", "unsha1ed", "SHA1 and SHA256") == {
        (1, "AES-256", "symmetric", 256), (2, "RSA", "asymmetric", 1024), (5, "KEYSIZE", "key", 4096), (7, "SHA-2", "hash", None)}


def test_lockfile_hashes_are_dependencies(spark):
    assert hits(spark, '"integrity": "sha512-abc"', name="x/package-lock.json") == {(1, "SHA-2", "dependency", None)}
    assert hits(spark, '"integrity": "sha512-abc"', name="x/a.json") == {(1, "SHA-2", "hash", None)}


@pytest.mark.parametrize(("line", "found"), [("ssl.PROTOCOL_TLSv1", {"TLS1.0"}), ("ssl.PROTOCOL_TLSv1_1", {"TLS1.1"}), ("ssl.TLSVersion.TLSv1_3", {"TLS1.3"}), ("ssl.PROTOCOL_TLS", set()), ("import ssl", set())])
def test_tls_constants(spark, line, found):
    assert {h[1] for h in hits(spark, line)} == found


def test_vendor_borders(spark):
    rows = spark.createDataFrame([("a", 1, "IconShield"), ("a", 2, "my_nshield2"), ("a", 3, "lunar")], "key string, line int, content string")
    assert [r.line for r in detect.hsm_findings(rows).collect()] == [2]


def test_lines_split_and_drop_last(spark):
    rows = spark.createDataFrame([("k", "a\r\nb\x0bc\n"), ("e", "")], "k string, t string")
    assert sorted((r.key, r.line, r.content) for r in lines(rows, F.col("k"), F.col("t")).collect()) == [("k", 1, "a"), ("k", 2, "b"), ("k", 3, "c")]


def test_delta_pairs_moves(spark):
    scan = lambda rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, fp string, severity string, ord long")
    got = delta.changes(scan([("a1", "f1", "low"), ("a2", "f2", "low"), ("c1", "g1", "low")]), scan([("a1", "f1", "low"), ("a3", "f3", "low"), ("c1x", "g1", "high")]))
    assert sorted((r.change, r.id, r.after_id) for r in got.collect()) == [("changed", "c1", "c1x"), ("new", "a3", None), ("resolved", "a2", None), ("unchanged", "a1", None)]
    assert [r.id for r in delta.regressions(got).collect()] == ["c1"]


def test_dedupe_first_wins(spark):
    rows = spark.createDataFrame([(2, "s", "p", 1, "A", "c", None, "", "", "", "u"), (1, "s", "p", 1, "A", "c", None, "", "", "", "u")], "ord long, scanner string, file_path string, line int, algorithm string, category string, key_size int, mode string, library string, curve string, usage string")
    assert [r.ord for r in score.dedupe(rows).collect()] == [1]


def test_binary_and_archive_sources(spark):
    found = {(r.algorithm, r.usage) for r in detect.binary_findings(files.binary_strings(literal_inputs.binaries(spark))).collect()}
    assert ("AES-256", "binary string reference") in found and ("OpenSSL", "binary symbol reference") in found
    assert [r.member for r in files.archive_members(literal_inputs.archives(spark)).collect() if "evil" in r.member] == []


def test_file_scan(spark, tmp_path):
    for name, body in (("a/x.py", b"md5"), ("a-b/y.bin", b"\0\1"), ("node_modules/z.py", b"md5")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    found = files.texts(files.files(spark, str(tmp_path))).collect()
    assert [r.path.rsplit("/", 2)[-2:] for r in found] == [["a", "x.py"]]


def test_code_analysis(spark):
    facts = code.python_facts(literal_inputs.table(spark, literal_inputs.SOURCES))
    assert [r.name for r in code.unused_imports(facts).collect()] == ["os"]
    assert [r.line for r in code.unreachable(facts).collect()] == [8]
    assert {r.name for r in code.unused_locals(facts).collect()} == {"key", "x"}
    assert [r.cyclomatic for r in code.complexity(facts).collect()] == [12]
    ranked = [r.score for r in code.analyse(facts).collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_duplicate_cover_has_no_overlap(spark):
    body = "\n".join(f"line number {i} of text" for i in range(14))
    texts = spark.createDataFrame([("a", body), ("b", body)], "path string, text string")
    got = duplication.cover(duplication.repeated(duplication.windows(texts))).collect()
    assert got and len({(r.path, r.start) for r in got}) == len(got)


def test_directories(spark):
    got = {(r.parent, r.child) for r in graph.directories(spark.createDataFrame([("a/b/c.py",)], "path string")).collect()}
    assert got == {("", "a"), ("a", "a/b"), ("a/b", "a/b/c.py")}


def test_telemetry_last_key_counts_and_stream_equals_batch(spark, tmp_path):
    rows = ["APP-TELEMETRY v=1 lib=a lib=b algo=RSA op=sign", "APP-TELEMETRY lib=a algo=RSA", "noise"]
    (tmp_path / "t.txt").write_text("\n".join(rows))
    batch = [(r.lib, r.algo, r.op) for r in telemetry.parse(spark.createDataFrame([(r,) for r in rows], "value string")).collect()]
    q = telemetry.stream(spark, str(tmp_path)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert batch == [("b", "RSA", "sign")] == [(r.lib, r.algo, r.op) for r in spark.table("seen").collect()]


def test_store_and_history(spark, tmp_path):
    e = spark.createDataFrame([("i", "critical")], "id string, severity string")
    for k in (1, 2):
        report.store_scan(e, str(tmp_path / "h"), f"s{k}", float(k))
    assert [r.scan_id for r in report.history(spark, str(tmp_path / "h")).collect()] == ["s2", "s1"]
    assert report.read_scan(spark, str(tmp_path / "h"), "s1").count() == 1


def test_whole_project_is_analysed(spark):
    from siltstone.plans import derived

    found = derived.code_project(spark, "/root/testdata/sf0.001")
    assert found.columns == ["path", "line", "name", "category", "title", "confidence", "score", "label"]
    rows = found.collect()
    assert {r.category for r in rows} == {"DEAD_CODE", "COMPLEXITY", "EFFICIENCY", "DUPLICATION", "DEPENDENCY", "STRUCTURE", "CONFIGURATION"}
    assert {r.name for r in rows if r.path.endswith(".js") and r.category == "EFFICIENCY"} == {"JSON.parse", "fetch"}


def test_duplicate_cover_passes_over_many_files_in_many_tasks(spark):
    rows = spark.range(3000).select(F.format_string("k%05d", "id").alias("key"), F.lit(2).cast("long").alias("occurrences"), F.lit(2).cast("long").alias("files"), F.format_string("f%d", F.expr("id div 3")).alias("path"),
                                    (F.col("id") % 3 * 7 + 1).cast("int").alias("start"), F.when(F.col("id") % 3 == 1, 12).otherwise(6).alias("width"))
    got = duplication.cover(rows, None)
    assert sorted((r.path, r.start) for r in got.collect()) == sorted((f"f{k}", s) for k in range(1000) for s in (1, 8))  # 15 lies in 8 to 20
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one task for all, before


def test_graph_health_passes_over_edges_once(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "node string, type string")
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "b", "r"), ("a", "c", "r"), ("a", "c", "r")], "source string, target string, relation string")
    got = graph.health(nodes, edges)
    assert {r.problem: r.n for r in got.collect()} == {"duplicate": 1, "dangling": 1}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3  # nodes twice, edges once
