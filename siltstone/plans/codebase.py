"""Queries of code analysis, structure, manifests and remediation on a code base that is written out of the documents; and their SQL.

Each document is a file: its number says where it lies, what it imports and which blocks it has, its first word names a variable. The SQL
works out from the numbers alone what an analysis must find; it never sees the files' text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import rules
from siltstone.operators import code, detect, graph, remedy, rollup, structure
from siltstone.plans.oracle import names
from siltstone.sources import manifests
from siltstone.sources.shared import kept
from siltstone.sources.tables import load, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def filled(template: str, **values: Column) -> Column:
    """The template with columns in place of {names}."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), values[name].cast("string")]
    return F.concat(*out, F.lit(rest))


# The files. t: the module imported, u: another that a test names in a string, w: the first short word.

BASE = ("import os\nimport json\nfrom core.m{t} import fn_{t}\n\ndef fn_{i}(a, b):\n    v_{w} = 1\n    return fn_{t}(a)\n    b = 2\n\ndef _hidden_{i}():\n    return {back}\n\n"
        "class Klass_{i}:\n    pass\n\n")
LOOPS = "for p in [1]:\n    for q in open(p):\n        json.loads(q)\n"
ROUTE = "@app.get('/r{k}')\ndef route_{i}():\n    return 'requirements.txt {i}'\n"
TEST = "def test_{i}():\n    assert 'm{t} m{u}'\n"
BUSY = "def busy_{i}(a, b, c, d, e, f):\n" + "".join(f"    if a == {k}:\n        b = {k}\n" for k in range(11)) + "    return b, c, d, e, f\n"
MAIN = "if __name__ == '__main__':\n    fn_{i}(1, 2)\n"


def project(spark: SparkSession, d: str) -> DataFrame:
    """(path, text)."""
    i = F.col("doc_id")
    t = F.when(i == 0, 6).otherwise(F.greatest(F.lit(0), i - i % 6 - 6 * (i % 4 + 1)))
    word = F.coalesce(F.regexp_extract("text", "[a-z]{3,5}", 0), F.lit(""))
    on = {"i": i, "t": t, "u": i - 1, "k": i % 10, "w": F.when(word == "", "none").otherwise(word), "back": F.when(i % 2 == 0, "os.name").otherwise("1")}
    path = (F.when(i % 6 == 0, filled("core/m{i}.py", **on)).when(i % 6 == 1, filled("web/m{i}.py", **on)).when(i % 6 == 2, filled("core/sub/m{i}.py", **on))
            .when(i % 6 == 3, filled("tests/test_m{i}.py", **on)).when(i % 6 == 4, filled("tools/t{i}/main.py", **on)).otherwise(filled("m{i}.py", **on)))
    block = lambda when, template: F.when(when, filled(template, **on)).otherwise("")
    text = F.concat(filled(BASE, **on), block(i % 5 == 0, "x_{i} = _hidden_{i}()\n"), block(i % 4 == 1, LOOPS), block(i % 6 == 1, ROUTE), block(i % 6 == 3, TEST), block(i % 50 == 10, BUSY), block(i % 7 == 0, MAIN))
    return spread(load(spark, d, "documents")).select(path.alias("path"), text.alias("text"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return kept(code.python_facts(project(spark, d)), "facts", by="kind")  # every analyzer reads some kinds of them


#: Documents as files: number, path, import, word, and where each block begins.
B = """WITH n AS (SELECT doc_id AS i, CASE doc_id % 6 WHEN 0 THEN 'core/m' || doc_id || '.py' WHEN 1 THEN 'web/m' || doc_id || '.py' WHEN 2 THEN 'core/sub/m' || doc_id || '.py' WHEN 3 THEN 'tests/test_m' || doc_id || '.py'
    WHEN 4 THEN 'tools/t' || doc_id || '/main.py' ELSE 'm' || doc_id || '.py' END AS path, CASE WHEN doc_id = 0 THEN 6 ELSE greatest(0, doc_id - doc_id % 6 - 6 * (doc_id % 4 + 1)) END AS t,
    coalesce(nullif(regexp_extract(coalesce(text, ''), '[a-z]{3,5}'), ''), 'none') AS w FROM documents),
b AS MATERIALIZED (SELECT *, 16 + (i % 5 = 0)::INT AS loops, 16 + (i % 5 = 0)::INT + 3 * (i % 4 = 1)::INT AS route, 16 + (i % 5 = 0)::INT + 3 * (i % 4 = 1)::INT + 3 * (i % 6 = 1)::INT AS test,
    16 + (i % 5 = 0)::INT + 3 * (i % 4 = 1)::INT + 3 * (i % 6 = 1)::INT + 2 * (i % 6 = 3)::INT AS busy FROM n),
named AS (SELECT DISTINCT t AS i FROM b),
imports AS (SELECT x.path AS source, y.path AS target, x.i, y.i AS j FROM b x JOIN b y ON y.i = x.t AND y.i % 6 = 0),
lone AS (SELECT path, i FROM b WHERE i % 6 <> 3 AND i % 7 <> 0 AND i NOT IN (SELECT j FROM imports)),
"""
#: What the analyzers find: (path, line, name, category, title, confidence, impact, effort, risk).
FOUND = B + """f AS (
  SELECT path, 1 AS line, 'os' AS name, 'DEAD_CODE' AS category, 'Unused import `os`' AS title, 'HIGH' AS confidence, 'LOW' AS impact, 'SMALL' AS effort, 'LOW' AS risk FROM b WHERE i % 2 = 1
  UNION ALL SELECT path, 2, 'json', 'DEAD_CODE', 'Unused import `json`', 'HIGH', 'LOW', 'SMALL', 'LOW' FROM b WHERE i % 4 <> 1
  UNION ALL SELECT path, 8, '', 'DEAD_CODE', 'Unreachable statement (line 8)', 'HIGH', 'LOW', 'SMALL', 'LOW' FROM b
  UNION ALL SELECT path, 6, 'v_' || w, 'DEAD_CODE', 'Unused local variable `v_' || w || '` in `fn_' || i || '`', 'MEDIUM', 'LOW', 'SMALL', 'LOW' FROM b
  UNION ALL SELECT path, 5, 'fn_' || i, 'DEAD_CODE', 'Potentially unused function `fn_' || i || '`', 'LOW', 'LOW', 'SMALL', 'MEDIUM' FROM b WHERE i % 7 <> 0 AND i NOT IN (SELECT i FROM named)
  UNION ALL SELECT path, 10, '_hidden_' || i, 'DEAD_CODE', CASE WHEN i % 6 = 3 THEN 'Potentially unused' ELSE 'Unused' END || ' function `_hidden_' || i || '`', CASE WHEN i % 6 = 3 THEN 'LOW' ELSE 'MEDIUM' END, 'LOW', 'SMALL', 'MEDIUM' FROM b WHERE i % 5 <> 0
  UNION ALL SELECT path, 13, 'Klass_' || i, 'DEAD_CODE', 'Potentially unused class `Klass_' || i || '`', 'LOW', 'LOW', 'SMALL', 'MEDIUM' FROM b
  UNION ALL SELECT path, route + 1, 'route_' || i, 'DEAD_CODE', 'Potentially unused function `route_' || i || '`', 'LOW', 'LOW', 'SMALL', 'MEDIUM' FROM b WHERE i % 6 = 1
  UNION ALL SELECT path, test, 'test_' || i, 'DEAD_CODE', 'Potentially unused function `test_' || i || '`', 'LOW', 'LOW', 'SMALL', 'MEDIUM' FROM b WHERE i % 6 = 3
  UNION ALL SELECT path, busy, 'busy_' || i, 'DEAD_CODE', 'Potentially unused function `busy_' || i || '`', 'LOW', 'LOW', 'SMALL', 'MEDIUM' FROM b WHERE i % 50 = 10
  UNION ALL SELECT path, busy, 'busy_' || i, 'COMPLEXITY', 'Complex function `busy_' || i || '`', 'HIGH', 'LOW', 'MEDIUM', 'MEDIUM' FROM b WHERE i % 50 = 10
  UNION ALL SELECT path, loops + 1, 'open', 'EFFICIENCY', 'Repeated `open` inside loop (line ' || (loops + 1) || ')', 'MEDIUM', 'MEDIUM', 'SMALL', 'LOW' FROM b WHERE i % 4 = 1
  UNION ALL SELECT path, loops + 2, 'loads', 'EFFICIENCY', 'Repeated `loads` inside loop (line ' || (loops + 2) || ')', 'MEDIUM', 'MEDIUM', 'SMALL', 'LOW' FROM b WHERE i % 4 = 1
  UNION ALL SELECT path, loops, '', 'EFFICIENCY', 'Nested loops (line ' || loops || ') — quadratic shape', 'LOW', 'MEDIUM', 'MEDIUM', 'LOW' FROM b WHERE i % 4 = 1),
v AS (SELECT *, CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END * CASE impact WHEN 'MEDIUM' THEN 2 ELSE 1 END / (CASE effort WHEN 'SMALL' THEN 1 ELSE 2 END * CASE risk WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS score FROM f),
a AS (SELECT path, line, name, category, title, confidence, score::DOUBLE AS score, 'c' || left(sha1(concat_ws('|', lower(category), category, path, line, name, title)), 11) AS id,
  CASE WHEN confidence = 'LOW' THEN 'REQUIRES_REVIEW' WHEN score >= 3 THEN 'QUICK_WIN' WHEN score >= 1.5 THEN 'LOW_RISK' ELSE 'REQUIRES_REVIEW' END AS label FROM v)
"""


@query(FOUND + "SELECT * FROM a")
def code_findings(spark, d):
    return code.analyse(facts(spark, d)).select("id", "path", "line", "name", "category", "title", "confidence", "score", "label")


@query(FOUND + "SELECT count(*) AS n, count(*) FILTER (confidence = 'HIGH') AS high, round_even(100 * (1 - count(*) FILTER (confidence = 'HIGH') / count(*)), 0)::INT AS score FROM a")
def code_health(spark, d):
    return rollup.health(code.analyse(facts(spark, d)))


@query(B + "z AS (SELECT 1) SELECT path, 'busy_' || i || ':' || busy AS scope, 'busy_' || i AS name, busy AS line, 12 AS cyclomatic, 1 AS nesting, 24 AS length, 6 AS parameters FROM b WHERE i % 50 = 10")
def code_complexity(spark, d):
    return code.complexity(facts(spark, d))


@query(B + "z AS (SELECT 1) SELECT source, target FROM imports")
def code_import_edges(spark, d):
    return code.import_edges(facts(spark, d))


@query(B + "z AS (SELECT 1) SELECT source, target, 'HIGH' AS confidence FROM imports")
def code_call_edges(spark, d):
    return code.call_edges(facts(spark, d))


@query(B + "z AS (SELECT 1) SELECT path FROM lone")
def code_orphans(spark, d):
    return code.orphans(facts(spark, d))


KINDS = """c AS (SELECT path, i, unnest([{'kind': 'def', 'name': 'fn_' || i, 'line': 5, 'ok': true}, {'kind': 'def', 'name': '_hidden_' || i, 'line': 10, 'ok': true}, {'kind': 'def', 'name': 'Klass_' || i, 'line': 13, 'ok': true}, {'kind': 'def', 'name': 'route_' || i, 'line': route + 1, 'ok': i % 6 = 1},
  {'kind': 'def', 'name': 'test_' || i, 'line': test, 'ok': i % 6 = 3}, {'kind': 'def', 'name': 'busy_' || i, 'line': busy, 'ok': i % 50 = 10}, {'kind': 'import', 'name': 'os', 'line': 1, 'ok': true}, {'kind': 'import', 'name': 'json', 'line': 2, 'ok': true}, {'kind': 'import', 'name': 'fn_' || t, 'line': 3, 'ok': true},
  {'kind': 'main-guard', 'name': '', 'line': busy + 24 * (i % 50 = 10)::INT, 'ok': i % 7 = 0}, {'kind': 'nested-loop', 'name': '', 'line': loops, 'ok': i % 4 = 1}, {'kind': 'loop-call', 'name': 'open', 'line': loops + 1, 'ok': i % 4 = 1}, {'kind': 'loop-call', 'name': 'loads', 'line': loops + 2, 'ok': i % 4 = 1},
  {'kind': 'unreachable', 'name': '', 'line': 8, 'ok': true}], recursive := true) FROM b)
"""


@query(B + KINDS + "SELECT path, kind, name, line FROM c WHERE ok")
def code_facts(spark, d):
    kinds = ["def", "import", "main-guard", "nested-loop", "loop-call", "unreachable"]
    return facts(spark, d).where(F.col("kind").isin(kinds)).select("path", "kind", "name", "line")


# Manifests: every document declares a package or two, in one of nine forms

KNOWN = sorted(rules.PACKAGES)
FORMS = {
    "requirements.txt": "# first\n{p}=={v}\nplain-{i}>=1\n", "package.json": '{{"dependencies": {{"{p}": "^{v}"}}, "devDependencies": {{"plain-{i}": "1"}}}}', "pyproject.toml": '[project]\ndependencies = ["{p}=={v}", "plain-{i}"]\n',
    "package-lock.json": '{{"packages": {{"": {{"version": "1"}}, "node_modules/x/node_modules/{p}": {{"version": "{v}"}}}}}}', "Cargo.toml": '[dependencies]\n{p} = "{v}"\nplain-{i} = {{ version = "1" }}\n',
    "Cargo.lock": '[[package]]\nname = "{p}"\nversion = "{v}"\n', "go.mod": "module m\nrequire example.org/{p} v{v}\n", "pom.xml": "<project><dependencies><dependency><artifactId>{p}</artifactId><version>{v}</version></dependency></dependencies></project>",
    "build.gradle": "implementation 'org.x:{p}:{v}'\n",
}


def declared(spark: SparkSession, d: str) -> DataFrame:
    """(path, text)."""
    i = F.col("doc_id")
    p = F.element_at(F.array(*map(F.lit, KNOWN)), (i % len(KNOWN) + 1).cast("int"))
    v = F.concat((i % 9).cast("string"), F.lit("."), (i % 4).cast("string"))

    def text(form: str) -> Column:
        pieces = form.replace("{{", "\1").replace("}}", "\2")
        return F.translate(filled(pieces, p=p, v=v, i=i), "\1\2", "{}")

    name, out = F.lit(""), F.lit("")
    for k, (n, form) in enumerate(FORMS.items()):
        name, out = F.when(i % 9 == k, n).otherwise(name), F.when(i % 9 == k, text(form)).otherwise(out)
    return load(spark, d, "documents").select(F.concat(F.lit("d"), i.cast("string"), F.lit("/"), name).alias("path"), out.alias("text"))


M = f"""WITH m AS (SELECT doc_id AS i, 'd' || doc_id || '/' || {list(FORMS)}[doc_id % 9 + 1] AS path, {KNOWN}[doc_id % {len(KNOWN)} + 1] AS p, (doc_id % 9) || '.' || (doc_id % 4) AS v, doc_id % 9 AS k FROM documents),
d AS (SELECT path, CASE WHEN k = 6 THEN 'example.org/' || p ELSE p END AS name, CASE WHEN k IN (0, 2) THEN '==' || v WHEN k = 1 THEN '^' || v WHEN k = 6 THEN 'v' || v ELSE v END AS version FROM m
  UNION ALL SELECT path, 'plain-' || i, CASE k WHEN 0 THEN '>=1' WHEN 2 THEN '' ELSE '1' END FROM m WHERE k IN (0, 1, 2, 4))
"""


@query(M + "SELECT * FROM d")
def declared_packages(spark, d):
    return manifests.declared_packages(declared(spark, d))


@query(M + f", t AS (SELECT * FROM (VALUES {', '.join(names((k, *(x if isinstance(x, (list, tuple)) else [x]))) for k, x in rules.PACKAGES.items())}) AS x(p, algorithm)) SELECT path AS file_path, algorithm, name AS library, version FROM d JOIN t ON t.p = lower(string_split(name, '/')[-1])")
def package_findings(spark, d):
    return detect.package_findings(manifests.declared_packages(declared(spark, d))).select("file_path", "algorithm", "library", "version")


@query(M + "SELECT path, name, version FROM d WHERE name LIKE 'plain-%' OR name <> 'plain'")
def code_dependency_use(spark, d):
    """Declared packages that no module imports."""
    return code.dependency_use(facts(spark, d), manifests.declared_packages(declared(spark, d))).select("path", "name", "version")


# Structure

EDGES = B + """top AS (SELECT *, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS top, regexp_replace(path, '/?[^/]*$', '') AS folder, 'file:' || path AS file FROM b),
folders AS (SELECT DISTINCT unnest(CASE WHEN folder LIKE '%/%' THEN [split_part(folder, '/', 1), folder] ELSE [folder] END) AS folder FROM top WHERE folder <> ''),
e AS (SELECT DISTINCT 'repo:' AS source, 'CONTAINS' AS relation, 'subsystem:' || top AS target, 'top-level directory ' || top AS evidence, 'HIGH' AS confidence FROM top
  UNION ALL SELECT CASE WHEN folder LIKE '%/%' THEN 'directory:' || split_part(folder, '/', 1) ELSE 'repo:' END, 'CONTAINS', 'directory:' || folder, 'directory ' || folder, 'HIGH' FROM folders
  UNION ALL SELECT CASE WHEN folder = '' THEN 'repo:' ELSE 'directory:' || folder END, 'CONTAINS', file, 'file ' || path, 'HIGH' FROM top
  UNION ALL SELECT file, 'BELONGS_TO', 'subsystem:' || top, path || ' lives under ' || top, 'HIGH' FROM top
  UNION ALL SELECT 'file:' || path, 'CONTAINS', 'symbol:' || path || '#' || name, path || ' defines ' || name, 'HIGH' FROM c WHERE ok AND kind = 'def'
  UNION ALL SELECT 'file:' || source, 'IMPORTS', 'file:' || target, source || ' imports ' || target, 'HIGH' FROM imports
  UNION ALL SELECT file, 'EXPOSES', 'entry:' || path, path || ' is an executable entry point', 'HIGH' FROM top WHERE i % 6 = 4 AND i % 7 = 0
  UNION ALL SELECT 'entry:' || path, 'ENTRY_POINT_FOR', 'repo:', path || ' starts the application', 'HIGH' FROM top WHERE i % 6 = 4 AND i % 7 = 0
  UNION ALL SELECT file, 'CONFIGURED_BY', 'config:requirements.txt', path || ' references requirements.txt in a string literal', 'MEDIUM' FROM top WHERE i % 6 = 1
  UNION ALL SELECT file, 'EXPOSES', 'api:GET /r' || i % 10, path || ' declares GET /r' || i % 10, 'MEDIUM' FROM top WHERE i % 6 = 1
  UNION ALL SELECT 'file:' || source, 'CALLS', 'file:' || target, source || ' references fn_' || j || ' defined in ' || target, 'HIGH' FROM imports
  UNION ALL SELECT 'file:' || source, 'TESTS', 'file:' || target, source || ' exercises ' || target, 'HIGH' FROM imports WHERE i % 6 = 3
  UNION ALL SELECT x.file, 'TESTS', y.file, x.path || ' exercises ' || y.path, 'MEDIUM' FROM top x JOIN top y ON y.i = x.i - 1 WHERE x.i % 6 = 3
  UNION ALL SELECT x.file, 'TESTS', y.file, x.path || ' exercises ' || y.path, 'MEDIUM' FROM top x JOIN top y ON y.i % 6 = 4 WHERE x.i % 6 = 3 AND x.i % 7 = 0),
w AS (SELECT 'r' || left(sha1(concat_ws('|', source, relation, target)), 11) AS id, * FROM e)
"""
EDGES = EDGES.replace("top AS (SELECT *, CASE", KINDS.rstrip().rstrip("\n") + ",\ntop AS (SELECT *, CASE", 1)


def edges_of(spark: SparkSession, d: str, tests: bool = True) -> tuple[DataFrame, DataFrame, structure.NamedTests | None]:
    """(facts, edges, tests by name, if they are wanted): the edges but for tests by name, whose ends are files and thus nodes already."""
    found = facts(spark, d)
    plain, named = structure.parts(project(spark, d), found)
    return found, kept(plain, "edges"), structure.NamedTests(*[kept(df, name) for name, df in named._asdict().items()]) if tests else None


def structure_of(spark: SparkSession, d: str, tests: bool = True) -> tuple[DataFrame, DataFrame, structure.NamedTests | None]:
    """(nodes, edges, tests by name)."""
    found, plain, named = edges_of(spark, d, tests)
    return kept(structure.nodes(plain, found), "nodes"), plain, named


@query(EDGES + "SELECT source, relation, target, evidence, confidence FROM e")
def structure_edges(spark, d):
    return structure.edges(project(spark, d), facts(spark, d)).select("source", "relation", "target", "evidence", "confidence")


NODES = EDGES + """, ids AS (SELECT source AS id FROM e UNION SELECT target FROM e),
q AS (SELECT id, split_part(id, ':', 1) AS k, regexp_replace(id, '^[a-z]+:', '') AS r FROM ids),
nodes AS (SELECT id, CASE k WHEN 'repo' THEN 'REPOSITORY' WHEN 'subsystem' THEN 'SUBSYSTEM' WHEN 'directory' THEN 'DIRECTORY' WHEN 'file' THEN 'FILE' WHEN 'entry' THEN 'ENTRY_POINT' WHEN 'config' THEN 'CONFIGURATION' WHEN 'api' THEN 'API_ENDPOINT'
    ELSE CASE WHEN r LIKE '%#Klass\\_%' ESCAPE '\\' THEN 'CLASS' ELSE 'FUNCTION' END END AS type,
  CASE k WHEN 'symbol' THEN split_part(r, '#', 2) WHEN 'entry' THEN 'entry:' || string_split(r, '/')[-1] WHEN 'file' THEN string_split(r, '/')[-1] WHEN 'directory' THEN string_split(r, '/')[-1] ELSE r END AS label,
  CASE WHEN k = 'api' THEN '' ELSE split_part(r, '#', 1) END AS path FROM q)
"""


@query(NODES + "SELECT * FROM nodes")
def structure_nodes(spark, d):
    found = facts(spark, d)
    return structure.nodes(structure.parts(project(spark, d), found)[0], found)


@query(B + "z AS (SELECT 1) SELECT path, 'GET' AS verb, '/r' || i % 10 AS route FROM b WHERE i % 6 = 1")
def structure_routes(spark, d):
    return structure.routes(project(spark, d))


@query(B + """z AS (SELECT 1) SELECT 'fn_' || x.t AS name, x.path FROM b x WHERE EXISTS (SELECT 1 FROM b y WHERE y.i = x.t)
UNION SELECT 'fn_' || i, path FROM b WHERE i % 7 = 0 UNION SELECT '_hidden_' || i, path FROM b WHERE i % 5 = 0""")
def structure_cross_references(spark, d):
    return structure.cross_references(facts(spark, d))


@query(EDGES + "SELECT * FROM (VALUES ('duplicate node ids', 0::BIGINT), ('duplicate relationships', 0), ('dangling ends', 0), ('edges without evidence', (SELECT count(*) FROM e WHERE evidence = '')), ('edges with bad confidence', 0)) AS t(problem, n)")
def structure_problems(spark, d):
    nodes, edges, named = structure_of(spark, d)
    return structure.graph_problems(nodes, edges, named)


PARTS = NODES + """, kept AS (SELECT id FROM nodes WHERE type NOT IN ('CLASS', 'FUNCTION', 'METHOD')), near AS (SELECT w.* FROM w JOIN kept x ON w.source = x.id JOIN kept y ON w.target = y.id)
"""


@query(PARTS + "SELECT source, relation, target FROM near")
def component_graph_edges(spark, d):
    """All edges between parts of the structure that are no symbols."""
    nodes, edges, named = structure_of(spark, d)
    return structure.component_graph(nodes, edges, None, None, named)[1].select("source", "relation", "target")


@query(PARTS + """, top800 AS (SELECT id FROM kept ORDER BY id LIMIT 800), inner_ AS (SELECT w.* FROM w JOIN top800 x ON w.source = x.id JOIN top800 y ON w.target = y.id)
SELECT greatest(0, (SELECT count(*) FROM kept) - 800)::BIGINT AS nodes_omitted, greatest(0, (SELECT count(*) FROM inner_) - 3000)::BIGINT AS relationships_omitted""")
def structure_component_caps(spark, d):
    nodes, edges, named = structure_of(spark, d)
    return structure.component_graph(nodes, edges, named=named)[2]


@query(NODES + """, ends AS (SELECT source AS id, relation, true AS out FROM e UNION ALL SELECT target, relation, false FROM e WHERE source <> target),
by_file AS (SELECT id, count(*) AS links, bool_or(out AND relation = 'PRODUCES_FINDING') AS finding, bool_or(out AND relation = 'EXPOSES') AS entry FROM ends WHERE id LIKE 'file:%' GROUP BY id)
SELECT *, row_number() OVER (ORDER BY finding DESC, links DESC, id) AS place FROM by_file WHERE finding OR entry OR links >= 3""")
def structure_noted_files(spark, d):
    """Every file worth a note, not the first sixty."""
    nodes, edges, named = structure_of(spark, d)
    return structure.noted_files(nodes, edges, None, named)


CANVAS = NODES + """, tops AS (SELECT id, label, type FROM nodes WHERE type = 'SUBSYSTEM' ORDER BY id LIMIT 8),
members AS (SELECT n.id, n.label, n.type, t.id AS of FROM e JOIN tops t ON e.target = t.id AND e.relation = 'BELONGS_TO' JOIN nodes n ON n.id = e.source AND n.type = 'FILE' QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY n.id) <= 4),
wanted AS (SELECT 0 AS band, '' AS of, id, label, type FROM tops UNION ALL SELECT 1, of, id, label, type FROM members UNION ALL (SELECT 3, '', id, label, type FROM nodes WHERE type = 'API_ENDPOINT' ORDER BY id LIMIT 6)
  UNION ALL (SELECT 4, '', id, label, type FROM nodes WHERE type = 'CONFIGURATION' ORDER BY id LIMIT 4)),
shown AS (SELECT id, label || chr(10) || type AS label, (k % 3 * 340)::INT AS x, (k // 3 * 170)::INT AS y FROM (SELECT *, row_number() OVER (ORDER BY band, of, id) - 1 AS k FROM wanted) WHERE k < 60)
"""


@query(CANVAS + "SELECT * FROM shown")
def structure_canvas(spark, d):
    nodes, edges, _ = structure_of(spark, d, tests=False)  # these are edges between files, and the canvas shows nodes
    return structure.system_canvas(nodes, edges)[0]


@query(CANVAS + "SELECT source, relation, target FROM w WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown) ORDER BY source, relation, target LIMIT 120")
def structure_canvas_edges(spark, d):
    nodes, edges, named = structure_of(spark, d)
    return structure.system_canvas(nodes, edges, named=named)[1].select("source", "relation", "target")


SURFACE = EDGES + """, st AS (SELECT 'f' || i AS id, path, 'file:' || path AS file FROM b WHERE i % 20 IN (0, 7)),
into_ AS (SELECT id, path, source, confidence FROM st JOIN e ON target = file AND relation = 'CALLS' WHERE source <> file),
out_ AS (SELECT id, path, file, relation, target, confidence FROM st JOIN e ON source = file),
hit AS (SELECT id, path, target, min(relation) AS relation, arg_min(confidence, relation) AS confidence FROM out_ o
  WHERE relation IN ('CALLS', 'IMPORTS') AND target <> file AND NOT EXISTS (SELECT 1 FROM into_ n WHERE n.id = o.id AND n.source = o.target) GROUP BY id, path, target),
seen AS (SELECT id, file FROM st UNION SELECT id, source FROM into_ UNION SELECT id, target FROM hit),
part AS (SELECT a.id, m.source AS file FROM st a JOIN e s ON s.source = a.file AND s.relation = 'BELONGS_TO' JOIN e m ON m.target = s.target AND m.relation = 'BELONGS_TO')
"""


@query(SURFACE + """SELECT id, 'DIRECTLY_AFFECTED' AS bucket, path, 'PRODUCES_FINDING' AS relation, 'HIGH' AS confidence, 'finding location' AS reason FROM st
UNION SELECT id, 'DIRECTLY_AFFECTED', source[6:], 'CALLS', confidence, 'references code in ' || path FROM into_
UNION SELECT id, 'INDIRECTLY_AFFECTED', target[6:], relation, confidence, CASE relation WHEN 'CALLS' THEN 'called by ' ELSE 'imported by ' END || path FROM hit
UNION SELECT id, 'CONFIGURATION_AFFECTED', target[8:], relation, confidence, 'configures ' || path FROM out_ WHERE relation = 'CONFIGURED_BY'
UNION SELECT id, 'API_AFFECTED', target[5:], relation, confidence, 'API exposed from ' || path FROM out_ WHERE relation = 'EXPOSES' AND target LIKE 'api:%'
UNION SELECT s.id, 'TEST_AFFECTED', e.source[6:], 'TESTS', e.confidence, 'tests ' || s.file[6:] FROM seen s JOIN e ON e.target = s.file AND e.relation = 'TESTS'
UNION SELECT id, 'OPTIONAL_REVIEW', file[6:], 'BELONGS_TO', 'MEDIUM', 'same subsystem, no direct link' FROM part p WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.id = p.id AND s.file = p.file)""")
def structure_affected_surface(spark, d):
    """What a change of each of a tenth of the files may touch."""
    _, edges, named = edges_of(spark, d)
    i = F.regexp_extract("path", r"[mt]([0-9]+)(?:/main)?\.py$", 1).cast("long")
    starts = project(spark, d).select("path", i.alias("i")).where("i % 20 in (0, 7)").select(F.concat(F.lit("f"), F.col("i").cast("string")).alias("id"), "path")
    return structure.affected_surface(edges, starts, named=named)


# Findings of a scan, hung on the files

@query(B + """g AS (SELECT i, path, CASE WHEN i % 4 = 0 THEN '/src/' || path WHEN i % 4 = 1 THEN path ELSE 'gone/' || path END AS p, 'f' || i AS id, CASE i % 3 WHEN 0 THEN 'RSA' WHEN 1 THEN 'MD5' ELSE '' END AS algorithm FROM b WHERE i % 8 <> 5)
SELECT 'file:' || path AS source, 'PRODUCES_FINDING' AS relation, 'finding:' || path || '#' || id AS target FROM g WHERE i % 4 < 2
UNION SELECT 'file:' || path, 'USES_CRYPTO', 'crypto:' || algorithm FROM g WHERE i % 4 < 2 AND algorithm <> ''""")
def structure_finding_edges(spark, d):
    i = F.regexp_extract("path", r"[mt]([0-9]+)", 1).cast("long")
    found = facts(spark, d)
    rows = project(spark, d).select("path", i.alias("i"))
    path = F.when(F.col("i") % 4 == 0, F.concat(F.lit("/src/"), "path")).when(F.col("i") % 4 == 1, F.col("path")).otherwise(F.concat(F.lit("gone/"), "path"))
    seen = rows.select(F.concat(F.lit("f"), F.col("i").cast("string")).alias("id"), path.alias("file_path"), F.lit("source").alias("scanner"),
                       F.when(F.col("i") % 3 == 0, "RSA").when(F.col("i") % 3 == 1, "MD5").otherwise("").alias("algorithm"), (F.col("i") % 8 == 5).alias("is_mock"))
    return structure.finding_edges(found, seen, "/src").select("source", "relation", "target")


# Remediation

TABLE = "(VALUES " + ", ".join(names(o[:7]) for o in remedy.OPTIONS) + ") AS o(category, option, title, description, risk, complexity, automation)"
CHOICES = FOUND + f""", o AS (SELECT a.id, path, name, a.confidence, o.* FROM a JOIN {TABLE} ON o.category = CASE WHEN a.category IN ('DEAD_CODE', 'DUPLICATION', 'EFFICIENCY', 'DEPENDENCY') THEN a.category ELSE '' END),
said AS (SELECT id, path, name, option, replace(replace(replace(title, '{{s}}', CASE WHEN name = '' THEN 'the flagged code' ELSE name END), '{{t}}', CASE WHEN name = '' THEN path ELSE name END), '{{f}}', path) AS title,
  replace(replace(replace(description, '{{s}}', CASE WHEN name = '' THEN 'the flagged code' ELSE name END), '{{t}}', CASE WHEN name = '' THEN path ELSE name END), '{{f}}', path) AS description,
  CASE WHEN option = 'delete' THEN CASE WHEN confidence = 'LOW' THEN 'MEDIUM' ELSE 'LOW' END ELSE risk END AS risk, complexity, automation FROM o)
"""


@query(CHOICES + "SELECT id, option, title, description, risk, complexity, automation FROM said")
def remediation_options(spark, d):
    return remedy.options(code.analyse(facts(spark, d))).select("id", "option", "title", "description", "risk", "complexity", "automation")


ASKED = ["require-tests", "no-new-dependencies", "minimize-files"]
def _task(place: int, title: str, what: str, why: str, expected: str, verify: str) -> str:
    """A task as SQL; texts are SQL already."""
    return f"{{'place': {place}, 'title': {title}, 'what': {what}, 'why': {why}, 'files': path, 'expected': {expected}, 'verify': {verify}}}"


def _q(text: str) -> str:
    return names([text])[1:-1]


GONE = _q("Re-run analysis; finding must be gone.")
TASKS = CHOICES + ", tasks AS (SELECT id, unnest([" + ", ".join([
    _task(1, _q("Confirm the finding"), f"'Verify: ' || {GONE}", _q("Never remediate an unconfirmed finding."), _q("Finding confirmed or rejected with evidence."), GONE),
    _task(2, "'Apply: ' || title", "description", "description", "'Change applied to ' || path || '; nothing else touched.'", GONE),
    *[_task(3 + k, _q(f"Constraint: {c}"), _q(remedy.CONSTRAINT_TASKS[c]), _q("User-selected constraint."), _q("Constraint honored."), _q(f"Reviewer confirms: {c}.")) for k, c in enumerate(["require-tests", "no-new-dependencies"])],
    _task(5, _q("Run tests and re-analyze"), _q("Run the project's test suite, then re-run the code analysis on the touched files."), _q("Behavior must be preserved; the finding must be gone."), _q("Tests pass; finding no longer reported."), _q("Test suite green.,Verification reports RESOLVED.")),
]) + "], recursive := true) FROM said WHERE option IN ('delete', 'hoist-cache', 'simplify'))\n"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    chosen = remedy.options(code.analyse(facts(spark, d))).where("option in ('delete', 'hoist-cache', 'simplify')")
    return remedy.plan_tasks(chosen, ASKED)


@query(TASKS + "SELECT * FROM tasks")
def remediation_plan(spark, d):
    return _tasks(spark, d).withColumns({"files": F.array_join("files", ","), "verify": F.array_join("verify", ",")})


@query(CHOICES + "SELECT id, option FROM said WHERE option NOT IN ('delete', 'hoist-cache', 'simplify')")
def remediation_rejected(spark, d):
    every = remedy.options(code.analyse(facts(spark, d)))
    return remedy.rejected_options(every, every.where("option in ('delete', 'hoist-cache', 'simplify')"))


@query(TASKS + "SELECT id, string_agg(place || '. **' || title || '**: ' || what, chr(10) ORDER BY place) AS text FROM tasks GROUP BY id")
def remediation_plan_text(spark, d):
    return remedy.markdown(_tasks(spark, d))


@query(B + "z AS (SELECT 1) SELECT x.target AS id, (row_number() OVER (PARTITION BY x.target ORDER BY x.i % 6 = 3 DESC, x.source))::INT AS place, x.source AS path FROM imports x")
def remediation_plan_files(spark, d):
    """The files of a plan for each module that others import: tests first."""
    found = code.import_edges(facts(spark, d))
    bucket = F.when(F.col("source").startswith("tests/"), "TEST_AFFECTED").otherwise("INDIRECTLY_AFFECTED")
    surface = found.select(F.col("target").alias("id"), bucket.alias("bucket"), F.col("source").alias("path"), F.lit("IMPORTS").alias("relation"))
    extra = found.select(F.col("target").alias("id"), F.lit("API_AFFECTED").alias("bucket"), F.lit("GET /r").alias("path"), F.lit("EXPOSES").alias("relation"))
    return remedy.plan_files(surface.unionByName(extra))


@query(B + "z AS (SELECT 1) SELECT 'core/m' || i || '.py' AS path FROM (SELECT DISTINCT i + 9 AS i FROM b WHERE i % 6 = 3) x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = 'core/m' || x.i || '.py')")
def plan_missing_files(spark, d):
    from siltstone.operators import notes

    i = F.regexp_extract("path", "test_m([0-9]+)", 1).cast("long")
    plan = project(spark, d).where("path like 'tests/%'").select(F.concat(F.lit("core/m"), (i + 9).cast("string"), F.lit(".py")).alias("path"))
    return notes.missing_files(plan, project(spark, d))


@query(B + """z AS (SELECT 1), p AS (SELECT DISTINCT path FROM b), s AS (SELECT path, string_split(path, '/') AS x FROM p)
SELECT DISTINCT array_to_string(x[1:k - 1], '/') AS parent, array_to_string(x[1:k], '/') AS child FROM s, unnest(range(1, len(x) + 1)) AS t(k)""")
def project_directories(spark, d):
    return graph.directories(project(spark, d).select("path"))
