"""Stores, streams, documents, images, scripts, listings and nested names: restarts, conflicts, limits and odd rows."""

import io
import json
import os
import random
import tarfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siltstone.functions import exprs
from siltstone.operators import detect, duplication, remedy, scripts, structure
from siltstone.plans import documents, remap, scan
from siltstone.plans.store import ScanStore, TriageStore
from siltstone.sources import files, images
from siltstone.streaming import observations

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


# Streams


def said(rng, n):
    """(scan, time, number, line): lines in order of time, with silences, repeats and noise."""
    at, out = START, []
    for k in range(n):
        at += timedelta(seconds=rng.choice([1, 5, 30, 60, 5000 if k % 41 == 0 else 2]))
        line = rng.choice(["noise", f"APP-TELEMETRY lib=l algo=a{rng.randrange(9)} op=use", f"APP-TELEMETRY lib=l{rng.randrange(3)} algo=RSA op=sign", "APP-TELEMETRY lib=x"])
        out.append((str(rng.randrange(3)), at, k, line))
    return out


def expected(rows, most, idle):
    """One by one, in order of time."""
    state, out = {}, []
    for scan_key, at, seq, line in sorted(rows, key=lambda r: (r[1], r[2])):
        fields = dict(p.split("=") for p in line.split() if "=" in p)
        if not {"lib", "algo", "op"} <= set(fields):
            continue
        last, known = state.get(scan_key, (None, []))
        if last is None or (at - last).total_seconds() > idle:
            known = []
        what = (fields["lib"], fields["algo"], fields["op"])
        if what not in known and len(known) < most:
            known = [*known, what]
            out.append((scan_key, len(known), seq, *what))
        state[scan_key] = (at, known)
    return sorted(out)


def test_stream_equals_table_through_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = said(rng, 300)
    schema = "scan_key string, at timestamp, seq long, value string"
    late = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(100)))  # not in order, but in time
    parts = [late[k : k + 60] for k in range(0, 300, 60)]
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    os.mkdir(source)

    def run(some):
        for k, p in some:
            spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{source}/{k}")
        lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        observations.sink(observations.stream_of_scans(lines, 4, 2000, 200), out, checkpoint).awaitTermination()

    run(list(enumerate(parts))[:2])
    first = observations.stored(spark, out).count()
    run(list(enumerate(parts))[2:])
    got = sorted((r.scan_key, r.place, r.seq, r.lib, r.algo, r.op) for r in observations.stored(spark, out).collect())
    until = max(r[1] for r in rows if "op=" in r[3]) - timedelta(seconds=200)
    when = {r[2]: r[1] for r in rows}
    want = expected(rows, 4, 2000)
    assert 0 < first < len(got) and got == [r for r in want if when[r[2]] <= until]
    table = observations.first_of_scans(spark.createDataFrame(rows, schema), 4, 2000)
    assert sorted((r.scan_key, r.place, r.seq, r.lib, r.algo, r.op) for r in table.collect()) == want


def test_stream_needs_idle_beyond_delay(spark):
    with pytest.raises(ValueError, match="idle"):
        observations.stream_of_scans(spark.createDataFrame([], "scan_key string, at timestamp, seq long, value string"), idle=1, delay=2)


# Stores


def scans(spark, *ids):
    return spark.createDataFrame([(f"s{i}", float(i), "critical", f"f{i}-{k}") for i in ids for k in range(i + 1)], "scan_id string, scan_time double, severity string, id string")


def on_disk(store):
    return sorted(x for n in store.folder.names("data") for x in store.folder.names(f"data/{n}") if "=" in x)


def test_scan_store_keeps_the_newest(spark, tmp_path):
    store = ScanStore(spark, str(tmp_path / "s"), keep=3)
    store.save(scans(spark, 1, 2))
    store.save(scans(spark, 2, 3))  # 2 again
    store.save(scans(spark, 0))  # too old to stay
    store.save(scans(spark, 5))
    assert [tuple(r) for r in store.history().collect()] == [("s5", 5.0, 6, 6, 0), ("s3", 3.0, 4, 4, 0), ("s2", 2.0, 3, 3, 0)]
    assert on_disk(store) == ["scan_id=s2", "scan_id=s3", "scan_id=s5"]
    assert store.read("s3").count() == 4 and store.read("s1") is None and store.previous("s5") == "s3" and store.previous("s2") is None
    assert store.delete("s3") and not store.delete("s3") and on_disk(store) == ["scan_id=s2", "scan_id=s5"]
    with pytest.raises(ValueError, match="scan id"):
        store.save(scans(spark, 1).withColumn("scan_id", F.lit("../x")))


def test_scan_store_without_a_limit_and_vacuum(spark, tmp_path):
    store = ScanStore(spark, str(tmp_path / "s"), keep=None)
    for k in range(3):
        store.save(scans(spark, k))
    scans(spark, 9).write.parquet(f"{store.path}/data/dead")  # of a writer that never committed
    assert store.vacuum() == [] and store.vacuum(0) == ["dead"]
    assert store.history().count() == 3 and store.read().count() == 6


def test_commits_that_meet_are_both_kept(spark, tmp_path):
    store = ScanStore(spark, str(tmp_path / "s"), keep=2)
    calls = []

    def change(entries):
        if not calls:  # another writer is quicker
            calls.append(1)
            ScanStore(spark, store.path, keep=2).save(scans(spark, 7))
        return store._newest(entries | {"s8": {"folder": "data/x/scan_id=s8", "scan_time": 8.0, "findings": 0, "critical": 0, "high": 0}})

    before, after = store.update(change)
    assert list(before) == ["s7"] and list(after) == ["s8", "s7"]


def test_triage_last_writer_by_seq(spark, tmp_path):
    store = TriageStore(spark, str(tmp_path / "t"), buckets=4)
    fields = "scope string, fingerprint string, status string, reason string, seq long"
    rows = lambda *r: spark.createDataFrame(list(r), fields)
    assert store.load() is None
    store.save(rows(("a", "f1", "reviewed", "x", 5), ("a", "f2", "open", None, 1), (None, "f", "open", None, 1)))
    store.save(rows(("a", "f1", "open", None, 4), ("a", "f2", "suppressed", "deferred", 2), ("b", "f1", "resolved", "", 1), ("b", "f1", "planned", "", 1)))
    store.save(rows(("a", "f2", "suppressed", "deferred", 2)))
    assert sorted(tuple(r) for r in store.load().select("scope", "fingerprint", "status", "reason", "seq").collect()) == [("a", "f1", "triaged", "", 5), ("a", "f2", "suppressed", "deferred", 2), ("b", "f1", "verified", "", 1)]
    for bad, why in ((("a", "f", "lost", "", 1), "unknown"), (("a", "", "open", "", 1), "fingerprint"), (("a", "f", "suppressed", "because", 1), "reason")):
        with pytest.raises(ValueError, match=why):
            store.save(rows(bad))
    assert store.load().count() == 3


def test_triage_writes_touched_buckets_only(spark, tmp_path):
    store = TriageStore(spark, str(tmp_path / "t"), buckets=8)
    row = lambda k, seq: (("s", f"f{k}", "open", "", seq))
    fields = "scope string, fingerprint string, status string, reason string, seq long"
    store.save(spark.createDataFrame([row(k, 1) for k in range(50)], fields))
    before = store.latest()[1]
    store.save(spark.createDataFrame([row(3, 2)], fields))
    after = store.latest()[1]
    assert sum(before[b] != after[b] for b in before) == 1 and store.load().count() == 50


# Nested names


def test_remap_keeps_places_nulls_and_empty_arrays(spark):
    rows = spark.createDataFrame([(1, ["a", None, "b", "a"], [("a", 1), (None, 2)], "b"), (2, [], None, None), (3, None, [("z", 3)], "z")], "k int, ids array<string>, links array<struct<id:string,n:int>>, one string")
    names = spark.createDataFrame([("id", "a", "A"), ("id", "b", "B"), ("path", "z", "Z"), ("id", "q", "q"), ("id", "a", "A")], "kind string, old string, new string")
    got = sorted(remap.remapped(rows, "k", {"ids": "id", "links.id": "id", "one": "id"}, names).collect())
    assert [(r.k, r.ids, r.links and [tuple(x) for x in r.links], r.one) for r in got] == [(1, ["A", None, "B", "A"], [("A", 1), (None, 2)], "B"), (2, [], None, None), (3, None, [("z", 3)], "z")]


# Documents


def test_documents_are_whole_json(spark, tmp_path):
    from siltstone.operators import score
    from siltstone.sources.tables import synthetic_findings

    e = score.enrich(synthetic_findings(spark, "/root/testdata/sf0.001").where("okey < 60")).withColumn("rationale", F.when(F.col("ord") % 2 == 0, "why \"so\"\n"))
    results = e.select(F.col("id").alias("finding_id"), F.lit("v").alias("validation_id"), F.lit("OBSERVED").alias("v_status"), F.lit("tls").alias("validation_type"), F.lit("RSA").alias("observed_algorithm"),
                       F.lit("").alias("observed_protocol"), F.lit("").alias("observed_cipher"), F.lit(1).alias("observed_key_size"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("seq")).where("seq < 7 or length(finding_id) > 0")
    parts = documents.write_sarif(e, str(tmp_path / "a"), results, provenance={"sha": "c" * 40, "owner": "o", "repo": "r", "canonical_url": "u"})
    run = json.loads(documents.text(spark, str(tmp_path / "a")))["runs"][0]
    ids = [r.id for r in e.orderBy("ord").collect()]
    assert [r["properties"]["crypto"]["finding_id"] for r in run["results"]] == ids and all(len(r["properties"]["validations"]) == 5 for r in run["results"])
    assert run["versionControlProvenance"][0]["revisionId"] == "c" * 40 and len(run["tool"]["driver"]["rules"]) == e.select("algorithm").distinct().count()
    assert all(os.path.getsize(tmp_path / "a" / r.file) == r.bytes for r in parts.collect())
    documents.write_cbom(e, str(tmp_path / "b"), "t", "now")
    whole = json.loads(documents.text(spark, str(tmp_path / "b")))
    assert [c["id"] for c in whole["components"]] == ids and whole["summary"]["total"] == len(ids) and sum(whole["riskSummary"]["priorities"].values()) == len(ids)
    documents.write(spark.createDataFrame([], "k int, json string"), ["k"], str(tmp_path / "c"), "[", "]")
    assert json.loads(documents.text(spark, str(tmp_path / "c"))) == []
    documents.write(spark.createDataFrame([(1, "1"), (1, "1"), (None, "2")], "k int, json string"), ["k"], str(tmp_path / "c"), "[", "]", 3)
    assert json.loads(documents.text(spark, str(tmp_path / "c"))) == [2, 1, 1]


# Images


def tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def layout(layers, config, through=0):
    """An image layout; `through` indices lie between its index and its manifest."""
    import hashlib

    blobs = {}

    def blob(data):
        blobs[h := hashlib.sha256(data).hexdigest()] = data
        return {"digest": f"sha256:{h}"}

    at = blob(json.dumps({"config": blob(config), "layers": [*map(blob, layers), {"digest": "sha256:../../x"}, {"digest": "sha256:" + "0" * 64}]}).encode())
    for _ in range(through):
        at = blob(json.dumps({"manifests": [at]}).encode())
    return {"oci-layout": b"{}", "index.json": json.dumps({"manifests": [at]}).encode()} | {f"blobs/sha256/{h}": d for h, d in blobs.items()}


LOWER = tar({"a/x": b"1", "a/y": b"1", "b/z": b"1", "b/sub/w": b"1", "top": b"1"})
UPPER = tar({"a/.wh.x": b"", "a/y": b"2", "b/.wh..wh..opq": b"", "b/new": b"2", ".wh.gone": b""})
CONFIG = b'{"config": {"Env": ["API_TOKEN=x", "PATH=/"]}}'


@pytest.mark.parametrize("form", ["saved", "layout", "nested"])
def test_images_by_name_and_by_digest(spark, form):
    parts = {"l0.tar": LOWER, "l1.tar": UPPER, "c.json": CONFIG, "manifest.json": json.dumps([{"Config": "c.json", "Layers": ["l0.tar", "l1.tar", "../x", "missing"]}]).encode()} if form == "saved" else layout([LOWER, UPPER], CONFIG, 2 if form == "nested" else 0)
    rows = spark.createDataFrame([("i.tar", bytearray(tar(parts))), ("bad.tar", bytearray(b"no")), ("cut.tar", bytearray(tar(parts)[:700]))], "path string, content binary")
    layers, configs = images.layers_of(images.members_of(rows))
    shown = images.effective(images.layer_members(layers))
    assert sorted((r.member, bytes(r.content), r.no) for r in shown.collect()) == [("a/y", b"2", 1), ("b/new", b"2", 1), ("top", b"1", 0)]
    assert [(r.image, json.loads(r.config)["config"]["Env"][0]) for r in configs.collect()] == [("i.tar", "API_TOKEN=x")]
    assert images.layers_of(images.members_of(rows), 1)[0].count() == 1
    folder = spark.createDataFrame([(f"w/i/{k}", bytearray(v)) for k, v in parts.items()] + [("w/other/index.json", bytearray(b"{}"))], "path string, content binary")
    layers, _ = images.layers_of(images.folders_of(folder))
    assert sorted((r.image, r.no) for r in layers.collect()) == [("w/i", 0), ("w/i", 1)]


# Scripts, duplicates, listings, paths, limits


def test_scripts_masked_by_state(spark):
    text = "const a1 = 'b2 // c3';\n/* d4\n e5 */ let f6 = `g7 ${h8}\n`; // i9\nfunction used1() { return \"x\\\"y\"; }\nexport { f6 as out7, used1 }\nclass Klass { }\nif (x) { }\nconst lone = 1"
    rows = spark.createDataFrame([("a.js", text), ("b.ts", "import { q } from './a';\nKlass;\n'open"), ("n.js", None), ("c.py", "lone")], "path string, text string")
    found = {(r.path, r.token, r.line) for r in scripts.tokens(rows).collect()}
    assert {t for p, t, _ in found if p == "a.js"} == {"const", "a1", "let", "f6", "function", "used1", "return", "export", "as", "out7", "class", "Klass", "if", "x", "lone"}
    assert ("a.js", "f6", 3) in found and ("a.js", "lone", 9) in found and ("b.ts", "Klass", 2) in found
    defined = {(r.name, r.exported) for r in scripts.definitions(rows).where("path = 'a.js'").collect()}
    assert defined == {("a1", False), ("f6", False), ("used1", True), ("out7", True), ("Klass", False), ("lone", False)}
    assert {r.name for r in scripts.unused_definitions(rows).collect()} == {"lone"}
    assert {r.name for r in scripts.unused_definitions(rows, 1).collect()} == {"a1", "lone"}


def greedy(rows):
    """The cover, one candidate after the other."""
    taken, out = {}, []
    for r in sorted(rows, key=lambda r: (-r.width, r.key)):
        if not any(a <= r.start <= b for a, b in taken.get(r.path, [])):
            taken.setdefault(r.path, []).append((r.start, r.start + r.width))
            out.append(r.key)
    return sorted(out)


def test_cover_is_the_greedy_one(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.random()}", 2, 2, rng.choice("ab"), rng.randrange(1, 400), rng.choice([12, 8, 6])) for _ in range(200)]
    df = spark.createDataFrame(rows, "key string, occurrences long, files long, path string, start int, width int")
    assert sorted(r.key for r in duplication.cover(df, None).collect()) == greedy(df.collect())
    assert duplication.cover(df, 5).count() == 5


def test_duplicates_of_numbers_and_strings(spark):
    body = "\n".join(f"x{i} = f('s', {{n}})" for i in range(8))
    texts = spark.createDataFrame([("a.py", body.replace("{n}", "0x1F")), ("b.py", "# c\n" + body.replace("{n}", "2.5"))], "path string, text string")
    assert duplication.repeated(duplication.windows(texts)).count() == 0
    assert {r.files for r in duplication.repeated(duplication.windows(texts, True)).collect()} == {2}
    assert {(r.category, r.confidence) for r in duplication.findings(texts).collect()} == {("DUPLICATION", "LOW")}


def test_listing_reads_names_only(spark, tmp_path):
    for name, n in (("a/x.py", 5), ("node_modules/z.py", 5), ("a-b/y.js", 9), ("big.py", 5000)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * n)
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "a" / "x.py", tmp_path / "l.py")
    names = lambda df: sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in df.collect())
    root = str(tmp_path)
    assert names(files.listing(spark, root, max_bytes=None)) == ["a-b/y.js", "a/x.py", "big.py"]
    assert names(files.listing(spark, root, max_bytes=100, languages=["python"])) == ["a/x.py"]
    assert names(files.files(spark, root, max_files=None, max_bytes=None)) == ["a-b/y.js", "a/x.py", "big.py"]
    assert names(files.files(spark, root, max_files=1)) == ["a/x.py"]
    before = spark.createDataFrame(files.listing(spark, root).collect())  # as a scan keeps it
    (tmp_path / "a/x.py").write_bytes(b"longer")
    (tmp_path / "new.py").write_bytes(b"x")
    os.remove(tmp_path / "a-b/y.js")
    got = {r.path.rsplit("/", 1)[1]: r.change for r in files.changed(before, files.listing(spark, root)).collect()}
    assert got == {"x.py": "modified", "new.py": "added", "y.js": "removed"}


@pytest.mark.parametrize(("path", "target"), [("a/b", "/w/a/b"), ("./a//b/", "/w/a/b"), ("/w", "/w"), ("/w/x", "/w/x"), ("/ww/x", None), ("/", None), ("a/../b", None), ("  ", None), ("x" * 1025, None), (None, None)])
def test_path_jail(spark, path, target):
    assert spark.createDataFrame([(path,)], "p string").select(exprs.jailed(F.col("p"), F.lit("/w/")).alias("t")).first().t == target


def test_normal_paths(spark):
    rows = spark.createDataFrame([("/a/./b/../c//d",), ("../../x",), ("a/..",), ("/..",)], "p string")
    assert [r.n for r in rows.select(exprs.normal_path(F.col("p")).alias("n")).collect()] == ["/a/c/d", "x", "", "/"]


def test_limits_of_a_scan_can_be_lifted(spark):
    body = b"\x7fELF\0" + b"\0".join(b"AES-256 n%d" % k if k else b"libcrypto.so.3" for k in range(200))
    row = spark.createDataFrame([("x", bytearray(body + b"\0RSA 2048\0"), len(body))], "path string, content binary, length long")
    names = lambda **limits: {r.algorithm for r in scan.scan_files(row, ["binary"], limits).collect()}
    assert names() == {"OpenSSL", "AES-256", "RSA"} and names(strings=1) == {"OpenSSL"} and names(findings=1) == {"OpenSSL"} and names(**scan.NO_LIMITS) == {"OpenSSL", "AES-256", "RSA"}
    strings = spark.createDataFrame([("x", k, f"AES-{b} of {k}") for k, b in enumerate([128, 192, 256])], "path string, place int, content string")
    assert [detect.binary_findings(strings, n).count() for n in (1, 2, None)] == [1, 2, 3]
    with pytest.raises(ValueError, match="unknown limits"):
        scan.scan_files(row, ["binary"], {"depth": 1})


def test_owner_is_the_first_path_by_parts(spark):
    rows = spark.createDataFrame([("a-b/x.py",), ("a/x.py",)], "path string")
    assert rows.agg(structure.first_path("path").alias("p")).first().p == "a/x.py"


def test_tasks_take_the_findings_own_words(spark):
    fields = "id string, path string, title string, description string, option string"
    plain = spark.createDataFrame([("x", "a.py", "T", "D", "delete")], fields)
    tasks = {r.place: r for r in remedy.plan_tasks(plain, ["require-tests", "preserve-tests"]).collect()}
    assert [tasks[k].title for k in sorted(tasks)] == ["Confirm the finding", "Apply: T", "Constraint: require-tests", "Constraint: preserve-tests", "Run tests and re-analyze"]
    assert tasks[2].why == "D" and tasks[2].files == ["a.py"] and tasks[2].expected == "Change applied to a.py; nothing else touched."
    own = plain.withColumns({"rationale": F.lit("R"), "verification": F.lit("V"), "files": F.array(F.lit("b.py"), F.lit("a.py"))})
    tasks = {r.place: r for r in remedy.plan_tasks(own).collect()}
    assert tasks[1].what == "Verify: V" and tasks[1].files == ["b.py"] and tasks[2].why == "R" and tasks[2].verify == ["V"] and tasks[3].files == ["b.py", "a.py"]
    every = plain.unionByName(plain.withColumn("option", F.lit("keep"))).unionByName(plain.withColumn("id", F.lit("y")))
    assert [tuple(r) for r in remedy.rejected_options(every, plain).collect()] == [("x", "keep")]


def test_affected_surface_in_order_of_closeness(spark):
    rows = [("file:a.py", "CALLS", "file:s.py"), ("file:s.py", "CALLS", "file:a.py"), ("file:s.py", "CALLS", "file:b.py"), ("file:s.py", "IMPORTS", "file:b.py"), ("file:s.py", "IMPORTS", "file:c.py"), ("file:t.py", "TESTS", "file:c.py"),
            ("file:u.py", "TESTS", "file:far.py"), ("file:s.py", "CONFIGURED_BY", "config:x.toml"), ("file:s.py", "EXPOSES", "api:GET /k"), ("file:s.py", "EXPOSES", "entry:s.py"), *[(f"file:{p}", "BELONGS_TO", "subsystem:m") for p in ("s.py", "a.py", "far.py")]]
    edges = spark.createDataFrame([(*r, "HIGH") for r in rows], "source string, relation string, target string, confidence string")
    starts = spark.createDataFrame([("f", "s.py"), ("g", "far.py"), ("f", "s.py")], "id string, path string")
    got = {(r.id, r.bucket, r.path, r.relation) for r in structure.affected_surface(edges, starts).collect()}
    assert got == {("f", "DIRECTLY_AFFECTED", "s.py", "PRODUCES_FINDING"), ("f", "DIRECTLY_AFFECTED", "a.py", "CALLS"), ("f", "INDIRECTLY_AFFECTED", "b.py", "CALLS"), ("f", "INDIRECTLY_AFFECTED", "c.py", "IMPORTS"), ("f", "TEST_AFFECTED", "t.py", "TESTS"),
                   ("f", "CONFIGURATION_AFFECTED", "x.toml", "CONFIGURED_BY"), ("f", "API_AFFECTED", "GET /k", "EXPOSES"), ("f", "OPTIONAL_REVIEW", "far.py", "BELONGS_TO"),
                   ("g", "DIRECTLY_AFFECTED", "far.py", "PRODUCES_FINDING"), ("g", "TEST_AFFECTED", "u.py", "TESTS"), ("g", "OPTIONAL_REVIEW", "s.py", "BELONGS_TO"), ("g", "OPTIONAL_REVIEW", "a.py", "BELONGS_TO")}
    assert structure.affected_surface(edges, starts, peers=False).where("bucket = 'OPTIONAL_REVIEW'").count() == 0
