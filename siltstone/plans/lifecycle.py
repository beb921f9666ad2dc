"""Queries of stores, streams, documents, images and scripts, on the given tables; and their SQL, written apart."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import exprs
from siltstone.operators import duplication, relate, score, scripts
from siltstone.plans import documents, oracle, remap, report
from siltstone.plans.store import ScanStore, TriageStore
from siltstone.sources import images
from siltstone.sources.shared import fresh, kept
from siltstone.sources.tables import load, spread, synthetic_findings
from siltstone.streaming import observations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


# Telemetry of scans. Ten programs say what they do; four hours of silence end a scan.

QUIET, LATE = 4 * 3600, 600


def _said(rows: DataFrame) -> DataFrame:
    """A telemetry line for each event."""
    value = F.concat(F.lit("APP-TELEMETRY v=1 lib="), "event_type", F.lit(" algo="), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit(" op=use"))
    return rows.select((F.col("user_id") % 10).cast("string").alias("scan_key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), value.alias("value"))


SEEN = f"""WITH l AS (SELECT (user_id % 10)::VARCHAR AS scan_key, ts AS t, event_id AS seq, event_type AS lib, json_extract_string(props, '$.k') AS algo FROM events),
g AS (SELECT *, coalesce(epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY scan_key ORDER BY t, seq)) > {QUIET}000000, true)::INT AS fresh FROM l WHERE algo <> ''),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY scan_key ORDER BY t, seq) AS run FROM g),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY scan_key, run, lib, algo ORDER BY t, seq) = 1),
p AS (SELECT *, (row_number() OVER (PARTITION BY scan_key, run ORDER BY t, seq))::INT AS place FROM f)
SELECT scan_key, place, seq, lib, algo, 'use' AS op, 'unknown' AS category FROM p WHERE place <= 50"""


@query(SEEN)
def telemetry_observations(spark, d):
    found = observations.with_category(observations.first_of_scans(_said(load(spark, d, "events")), idle=QUIET))
    return found.select("scan_key", "place", "seq", "lib", "algo", "op", "category")


@query(SEEN + f" AND epoch_us(t) <= (SELECT epoch_us(max(t)) // 1000 * 1000 - {LATE}000000 FROM l)")
def telemetry_stream(spark, d):
    """The same from a stream: what the watermark has passed when the input ends."""
    events = load(spark, d, "events")
    lines = _said(spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]"))  # a pattern, as the table may be one file
    where = fresh(spark, "telemetry")
    observations.sink(observations.stream_of_scans(lines, idle=QUIET, delay=LATE), f"{where}/rows", f"{where}/checkpoint").awaitTermination()
    return observations.with_category(observations.stored(spark, f"{where}/rows")).select("scan_key", "place", "seq", "lib", "algo", "op", "category")


# Stores


def _event_scans(spark: SparkSession, d: str) -> DataFrame:
    """Eight events in a row are a scan."""
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "high").otherwise("low")
    return load(spark, d, "events").select(F.concat(F.lit("s"), F.floor(F.col("event_id") / 8).cast("string")).alias("scan_id"), F.floor(F.col("event_id") / 8).cast("double").alias("scan_time"), "event_id", severity.alias("severity"))


@query("""SELECT concat('s', event_id // 8) AS scan_id, count(*) AS findings, count(*) FILTER (event_type = 'error') AS critical, sum(event_id)::BIGINT AS ids
FROM events GROUP BY event_id // 8 QUALIFY row_number() OVER (ORDER BY event_id // 8 DESC) <= 500""")
def scan_store_newest(spark, d):
    """Scans saved in three commits, one of them a retry; what then lies on disk."""
    store, scans = ScanStore(spark, fresh(spark, "scans")), _event_scans(spark, d)
    old = F.floor(F.col("event_id") / 8) % 3 == 0
    for some in (scans.where(old), scans.where(~old), scans.where(old)):
        store.save(some)
    on_disk = spark.read.option("recursiveFileLookup", True).parquet(f"{store.path}/data").withColumn("scan_id", F.regexp_extract(F.col("_metadata.file_path"), "scan_id=([^/]+)/", 1))
    return on_disk.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "critical").alias("critical"), F.sum("event_id").alias("ids"))


STATES = ["open", "reviewed", "planned", "in_progress", "fixed", "resolved", "suppressed"]


@query("""SELECT (user_id % 7)::VARCHAR AS scope, event_type || '-' || (event_id % 40) AS fingerprint, max(event_id) AS seq,
  ['open', 'triaged', 'planned', 'in_progress', 'fixed', 'verified', 'suppressed'][max(event_id) % 7 + 1] AS status, CASE WHEN max(event_id) % 7 = 6 THEN 'deferred' ELSE '' END AS reason
FROM events GROUP BY 1, 2""")
def triage_saved(spark, d):
    """Entries saved newest first, then older ones, some twice: the last writer by seq counts."""
    status = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % 7 + 1).cast("int"))
    rows = load(spark, d, "events").select((F.col("user_id") % 7).cast("string").alias("scope"), F.concat_ws("-", "event_type", (F.col("event_id") % 40).cast("string")).alias("fingerprint"),
                                           status.alias("status"), F.lit("deferred").alias("reason"), F.col("event_id").alias("seq"))
    store = TriageStore(spark, fresh(spark, "triage"))
    for part in (rows.where("seq % 3 = 2"), rows.where("seq % 3 <> 2"), rows.where("seq % 3 = 2")):
        store.save(part)
    return store.load().select("scope", "fingerprint", "status", "reason", "seq")


# Nested names


@query(oracle.E_ + """, m AS (SELECT okey, ord, scanner, algorithm, category, key_size, curve, usage, line, family, file_path, left(sha1(concat_ws('|', scanner, 'o/r@c/' || file_path, line::VARCHAR, algorithm, category,
  coalesce(key_size::VARCHAR, 'None'), curve, usage)), 12) AS new_id FROM e)
SELECT okey, string_agg(new_id, ',' ORDER BY ord) AS ids, string_agg(new_id || ':' || family, ',' ORDER BY ord) AS related, string_agg('o/r@c/' || file_path, ',' ORDER BY ord) AS artifacts, first(new_id ORDER BY ord) AS finding_id FROM m GROUP BY okey""")
def remapped_arrays(spark, d):
    """Arrays of ids, of links and of paths, and single ids, after the findings they name have moved below a logical prefix."""
    e = score.enrich(synthetic_findings(spark, d).withColumn("file_path", F.concat(F.lit("/w/"), "file_path")))
    v = F.array_sort(F.collect_list(F.struct("ord", "id", "family", "file_path")))  # one list, so that both readings of rows share its shuffle
    rows = e.groupBy("okey").agg(v.alias("v")).select("okey", F.col("v.id").alias("ids"), F.transform("v", lambda x: F.struct(x["id"].alias("id"), x["family"].alias("relation"))).alias("related"),
                                                      F.col("v.file_path").alias("artifacts"), F.col("v")[0]["id"].alias("finding_id"))
    moved = report.relativized(e, "/w", "o/r@c")
    out = remap.remapped(rows, "okey", {"ids": "id", "related.id": "id", "artifacts": "path", "finding_id": "id"}, remap.names_of(moved))
    links = F.transform("related", lambda x: F.concat_ws(":", x["id"], x["relation"]))
    return out.select("okey", F.array_join("ids", ",").alias("ids"), F.array_join(links, ",").alias("related"), F.array_join("artifacts", ",").alias("artifacts"), "finding_id")


# Documents


@query(oracle.E_ + """SELECT ord, 'CRYPTO-' || replace(algorithm, ' ', '-') AS rule, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, file_path AS uri, greatest(1, line) AS line, id AS finding_id,
  row_number() OVER (ORDER BY ord) AS place FROM e""")
def sarif_document(spark, d):
    """The results of a written document, in the order they stand there; each says which finding it was."""
    e = score.enrich(synthetic_findings(spark, d))
    where = fresh(spark, "sarif")
    documents.write_sarif(e, where, properties=("ord",))
    fields = "ruleId string, level string, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>, properties struct<crypto struct<finding_id string>, ord bigint>"
    rows, at = documents.placed_lines(spark, where, fields), F.col("r.locations")[0]["physicalLocation"]
    return rows.select("place", F.col("r.ruleId").alias("rule"), "r.level", at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("line"), F.col("r.properties.crypto.finding_id").alias("finding_id"), F.col("r.properties.ord").alias("ord"))


@query(oracle.E_ + """SELECT f.* FROM (SELECT count(*) AS total, count(*) FILTER (exposed) AS exposed, count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (severity = 'critical') AS critical, array_to_string(list_sort(list(DISTINCT algorithm)), ',') AS algorithms,
  (SELECT string_agg(recommend, ',' ORDER BY first) FROM (SELECT recommend, min(ord) AS first FROM e WHERE recommend <> '' GROUP BY recommend)) AS recommendations, array_to_string(list_sort(list(DISTINCT family)), ',') AS families, (SELECT count(*) FROM e) AS components FROM e) f""")
def cbom_written(spark, d):
    """What a written bill of materials says: its header and footer, and how many components it has."""
    e = score.enrich(synthetic_findings(spark, d))
    where = fresh(spark, "cbom")
    documents.write_cbom(e, where, "t", "2024-01-01T00:00:00+00:00")
    ends = spark.read.text([f"{where}/head", f"{where}/tail"], wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_path"), "[^/]*$", 0).alias("name"))
    head = ends.where("name = 'head'").select(F.from_json(F.concat(F.rtrim(F.regexp_replace("value", r"\s+$", "")), F.lit("]}")), "summary struct<total bigint, bySeverity map<string, bigint>>, riskSummary struct<moscaExposed bigint, priorities map<string, bigint>>, metadata struct<algorithmInventory array<string>>, recommendations array<string>").alias("h"))
    tail = ends.where("name = 'tail'").select(F.from_json(F.concat(F.lit('{"components": ['), "value"), "intelligence struct<inventory array<struct<family string>>>").alias("t"))
    n = documents.lines(spark, where).agg(F.count(F.lit(1)).alias("components"))
    rows = head.withColumn("k", F.lit(0)).join(tail.withColumn("k", F.lit(0)), "k").join(n.withColumn("k", F.lit(0)), "k")  # a row each
    return rows.select("h.summary.total", F.col("h.riskSummary.moscaExposed").alias("exposed"), F.col("h.riskSummary.priorities")["P0"].alias("p0"), F.col("h.summary.bySeverity")["critical"].alias("critical"),
                       F.array_join("h.metadata.algorithmInventory", ",").alias("algorithms"), F.array_join("h.recommendations", ",").alias("recommendations"),
                       F.array_join(F.array_sort(F.transform("t.intelligence.inventory", lambda x: x["family"])), ",").alias("families"), "components")


# Duplicates


COVERED = f"""WITH w AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM ({oracle.WINDOWS.format(w=w, body=b, keep=oracle.KEPT, kind=k)})" for w in (12, 8, 6) for b, k in ((oracle.STRIPPED, "exact"), (oracle.MASKED, "near")))}),
g AS (SELECT key, count(*) AS occurrences, count(DISTINCT path) AS files, first({{'path': path, 'start': start, 'width': width}} ORDER BY path, width DESC, start) AS f FROM w GROUP BY key HAVING count(*) >= 2),
c AS (SELECT key, occurrences, files, f.path AS path, f.start AS start, f.width AS width FROM g WHERE files > 1 OR (f.width >= 12 AND key LIKE 'exact%')),
l AS (SELECT path, list([{{'key': key, 'a': start, 'b': start + width}}] ORDER BY width DESC, key) AS spans FROM c GROUP BY path),
t AS (SELECT path, unnest(list_reduce(spans, lambda taken, x: CASE WHEN len(list_filter(taken, lambda y: x[1].a BETWEEN y.a AND y.b)) > 0 THEN taken ELSE taken || x END)) AS s FROM l)
SELECT c.* FROM c JOIN t ON c.path = t.path AND c.key = t.s.key"""


@query(COVERED)
def duplicate_cover(spark, d):
    texts = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    found = duplication.windows(texts).unionByName(duplication.windows(texts, True))
    return duplication.cover(duplication.repeated(found), None)


# Scripts: three statements, a comment and an export out of the first words of each document


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), F.lit(1))
    at = lambda i: F.coalesce(F.try_element_at(F.col("w"), F.lit(i)), F.lit("none"))
    code = F.concat(F.lit("const k_"), at(1), F.lit(" = use("), at(2), F.lit(", 'f_"), at(3), F.lit(" // no comment');\nfunction f_"), at(3), F.lit("(x) {\n  return k_"), at(4), F.lit(";\n}\n/* f_"), at(5),
                    F.lit("\n k_"), at(1), F.lit(" */ export class c_"), at(5), F.lit(" { }\n// k_"), at(1), F.lit("\nlet v_"), at(6), F.lit(" = `k_"), at(1), F.lit("\n`;\n"))
    return spread(load(spark, d, "documents")).withColumn("w", w).select(F.concat(F.lit("js/"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), code.alias("text"))


PARTS = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]{3,}') AS w FROM documents),
d AS (SELECT 'js/' || doc_id || '.js' AS path, ['k_' || coalesce(w[1], 'none'), 'f_' || coalesce(w[3], 'none'), 'c_' || coalesce(w[5], 'none'), 'v_' || coalesce(w[6], 'none'), 'k_' || coalesce(w[4], 'none'), coalesce(w[2], 'none')] AS n FROM w),
said AS (SELECT path, unnest([{'t': 'const', 'l': 1}, {'t': n[1], 'l': 1}, {'t': 'use', 'l': 1}, {'t': n[6], 'l': 1}, {'t': 'function', 'l': 2}, {'t': n[2], 'l': 2}, {'t': 'x', 'l': 2}, {'t': 'return', 'l': 3}, {'t': n[5], 'l': 3},
  {'t': 'export', 'l': 6}, {'t': 'class', 'l': 6}, {'t': n[3], 'l': 6}, {'t': 'let', 'l': 8}, {'t': n[4], 'l': 8}]) AS s FROM d)
"""


@query(PARTS + "SELECT path, s.t AS token, s.l AS line FROM said")
def script_tokens(spark, d):
    return scripts.tokens(_scripts(spark, d)).select("path", "token", "line")


@query(PARTS + "SELECT path, unnest([{'name': n[1], 'line': 1, 'exported': false}, {'name': n[2], 'line': 2, 'exported': false}, {'name': n[3], 'line': 6, 'exported': true}, {'name': n[4], 'line': 8, 'exported': false}], recursive := true) FROM d")
def script_definitions(spark, d):
    return scripts.definitions(_scripts(spark, d))


@query(PARTS + """, c AS (SELECT s.t AS name, path, count(*) AS n FROM said GROUP BY ALL), o AS (SELECT path, unnest([{'name': n[1], 'line': 1}, {'name': n[2], 'line': 2}, {'name': n[4], 'line': 8}], recursive := true) FROM d)
SELECT o.path, o.line, o.name FROM o JOIN c ON o.name = c.name AND o.path = c.path WHERE n = 1 AND (SELECT count(*) FROM c x WHERE x.name = o.name) = 1""")
def script_unused(spark, d):
    return scripts.unused_definitions(_scripts(spark, d))


# Images: fifty documents in a row are an image of five layers; some documents are whiteouts


def _pack(named: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, body in named.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def _images(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): every other one a saved image, the others image layouts."""
    import hashlib
    import json

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        layers = [_pack(dict(zip(g["member"], g["text"].str.encode("utf-8"), strict=True))) for _, g in pdf.groupby("no")]
        config = json.dumps({"config": {"Env": ["PATH=/bin", f"DB_PASSWORD_{key[0]}=x"]}}).encode()
        if key[0] % 2:
            parts = {f"{k}/layer.tar": body for k, body in enumerate(layers)} | {"c.json": config}
            parts["manifest.json"] = json.dumps([{"Config": "c.json", "Layers": list(parts)[:-1]}]).encode()
        else:
            name = lambda body: "sha256:" + hashlib.sha256(body).hexdigest()
            manifest = json.dumps({"config": {"digest": name(config)}, "layers": [{"digest": name(x), "mediaType": "application/vnd.oci.image.layer.v1.tar"} for x in layers]}).encode()
            parts = {"blobs/" + name(x).replace(":", "/"): x for x in (*layers, config, manifest)}
            parts |= {"oci-layout": b'{"imageLayoutVersion": "1.0.0"}', "index.json": json.dumps({"manifests": [{"digest": name(manifest)}]}).encode()}
        return pd.DataFrame({"path": [f"img{key[0]}.tar"], "content": [_pack(parts)]})

    i = F.col("doc_id")
    member = F.when(i % 50 == 33, "srv/.wh..wh..opq").when(i % 13 == 5, F.concat(F.lit("srv/.wh."), (i % 10).cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("srv/"), (i % 10).cast("string"), F.lit(".txt")))
    rows = load(spark, d, "documents").select("doc_id", F.floor(i / 50).alias("image"), (F.floor(i / 10) % 5).alias("no"), member.alias("member"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("image").applyInPandas(build, "path string, content binary")


SHOWN = """WITH r AS (SELECT doc_id // 50 AS image, (doc_id // 10) % 5 AS no, 'srv/' || doc_id % 10 || '.txt' AS member, CASE WHEN doc_id % 50 = 33 THEN 'opaque' WHEN doc_id % 13 = 5 THEN 'gone' ELSE 'file' END AS kind, coalesce(text, '') AS text FROM documents)
SELECT 'img' || image || '.tar' AS image, member, no::INT AS no, strlen(text)::BIGINT AS n_bytes, sha256(text) AS sha FROM r WHERE kind = 'file'
  AND no = (SELECT max(no) FROM r x WHERE x.image = r.image AND x.member = r.member AND x.kind = 'file')
  AND NOT EXISTS (SELECT 1 FROM r x WHERE x.image = r.image AND x.no > r.no AND ((x.kind = 'gone' AND x.member = r.member) OR x.kind = 'opaque'))"""


@query(SHOWN)
def image_files(spark, d):
    """What images show when their layers lie on each other."""
    layers, _ = images.layers_of(kept(images.members_of(_images(spark, d)), "members"), None)
    found = images.effective(images.layer_members(layers, members=None, peek=None, budget=None))
    return found.select("image", "member", "no", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha"))


@query("SELECT DISTINCT 'img' || doc_id // 50 || '.tar' AS image, 'DB_PASSWORD_' || doc_id // 50 AS name FROM documents")
def image_secret_names(spark, d):
    from siltstone.operators.notes import secret_variables

    _, configs = images.layers_of(kept(images.members_of(_images(spark, d)), "members"))
    return secret_variables(configs.withColumnRenamed("image", "path")).select(F.col("path").alias("image"), "name")


# Paths


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS part FROM pages),
q AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN part WHEN 1 THEN '/w/./' || part WHEN 2 THEN 'a/../' || part WHEN 3 THEN '/ww/' || part ELSE '//w//' || part || '/.' END AS path FROM p)
SELECT page_id, CASE WHEN trim(path) <> '' AND page_id % 5 NOT IN (2, 3) THEN regexp_replace('/w/' || array_to_string(list_filter(string_split(CASE WHEN page_id % 5 IN (1, 4) THEN substr(regexp_replace(path, '^/+w/+', '/'), 2) ELSE path END, '/'),
  lambda x: x <> '' AND x <> '.'), '/'), '/$', '') END AS target FROM q""")
def jailed_paths(spark, d):
    """Paths made of the pages' addresses, held to one root."""
    part, k = F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1), F.col("page_id") % 5
    path = F.when(k == 0, part).when(k == 1, F.concat(F.lit("/w/./"), part)).when(k == 2, F.concat(F.lit("a/../"), part)).when(k == 3, F.concat(F.lit("/ww/"), part)).otherwise(F.concat(F.lit("//w//"), part, F.lit("/.")))
    return load(spark, d, "pages").select("page_id", exprs.jailed(path, F.lit("/w")).alias("target"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 8 THEN 'unknown triage status ''lost''' WHEN event_id % 4 = 0 THEN 'fingerprint is required' WHEN event_id % 9 = 6 AND event_id % 3 <> 1 THEN 'suppression requires a reason' END AS fault FROM events""")
def triage_faults(spark, d):
    """Why entries can't be recorded."""
    status = F.element_at(F.array(*map(F.lit, [*STATES, "verified", "lost"])), (F.col("event_id") % 9 + 1).cast("int"))
    fingerprint = F.when(F.col("event_id") % 8 == 0, "").when(F.col("event_id") % 4 == 0, F.repeat(F.lit("f"), 65)).otherwise("f1")
    reason = F.when(F.col("event_id") % 3 == 1, "duplicate").otherwise("because")
    return load(spark, d, "events").select("event_id", relate.triage_fault(relate.migrated_triage(status), fingerprint, reason).alias("fault"))
