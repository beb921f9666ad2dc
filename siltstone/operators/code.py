"""Code analysis: facts of Python sources as rows, and the analyzers as joins, anti-joins and projections over them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import exprs
from siltstone.operators import duplication, scripts
from siltstone.operators.score import limit_per
from siltstone.operators.structure import STANDARD, first_path, overlapping_configs, resolved_imports, stem_of

#: Thresholds of complexity, calls that cost in a loop, receivers that make get and post a request, signs of dynamic code. Fixed values.
CYCLOMATIC, NESTING, LENGTH, PARAMETERS = 10, 4, 80, 6
COSTLY_NAMES = ["open", "compile", "sleep", "connect"]
COSTLY_METHODS = ["read", "readlines", "read_text", "loads", "load", "dumps", "dump", "parse", "request", "fetch", "query", "execute"]
NETWORK = ["requests", "session", "http", "client", "api", "urllib", "httpx", "aiohttp", "urlopen"]
INSPECTORS = ["ast", "asdict", "dataclasses"]
DYNAMIC_CALLS = ["getattr", "eval", "exec", "__import__"]
DYNAMIC_WORDS = ["getattr", "globals(", "locals(", "eval(", "exec(", "__import__", "importlib", "registry", "register", "route(", "add_route", "urlpatterns", "router", "plugin", "entry_points", "setup(", "app.route"]
ENTRY_POINTS = ["main", "__main__", "setup", "teardown", "run", "execute", "cli", "app"]
#: Import names of distributions that are called otherwise. Fixed values.
IMPORT_NAMES = {"pillow": "pil", "beautifulsoup4": "bs4", "scikit-learn": "sklearn", "scikit-image": "skimage", "pyyaml": "yaml", "python-dateutil": "dateutil", "opencv-python": "cv2", "protobuf": "google"}

#: About as many facts leave a worker at once, and as many files are Python objects there at once. Fixed values.
FACT_ROWS, HELD_FILES = 5000, 128
FACTS = "path string, kind string, name string, line int, scope string, detail string, n int"
_FACTS = pa.schema([(n, pa.int32() if n in ("line", "n") else pa.string()) for n in ("path", "kind", "name", "line", "scope", "detail", "n")])
LOOPS = (ast.For, ast.AsyncFor, ast.While)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
BRANCHES = (ast.If, *LOOPS, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Assert, ast.Match)
LEVELS = (ast.If, *LOOPS, ast.With, ast.AsyncWith, ast.Try, ast.Match)
ENDS = (ast.Return, ast.Raise, ast.Break, ast.Continue)
#: Nodes that hold nothing, and those that may hold a list of statements.
BARE = (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)
BLOCKS = (ast.stmt, ast.mod, ast.ExceptHandler, ast.match_case)


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    """Half of a surrogate pair, which a literal may name, has no UTF-8 form and becomes a question mark."""
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array([v.encode("utf-8", "replace").decode() for v in values], kind)


class Facts(ast.NodeVisitor):
    """Rows (kind, name, line, scope, detail, n) of a module, from one walk that knows the enclosing functions and loops."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.functions: list[ast.AST] = []
        self.loops: list[ast.AST] = []

    def add(self, kind: str, name: str = "", line: int = 0, scope: str = "", detail: str = "", n: int = 0) -> None:
        self.rows.append((kind, name, line, scope, detail, n))

    def scopes(self) -> list[str]:
        return [f"{f.name}:{f.lineno}" for f in self.functions]

    def visit(self, node: ast.AST) -> None:
        if isinstance(node, BARE):
            return
        for field in ("body", "orelse", "finalbody") if isinstance(node, BLOCKS) else ():
            block, ended = getattr(node, field, None), False
            for stmt in block if isinstance(block, list) else []:
                if ended and not isinstance(stmt, ast.Expr):
                    self.add("unreachable", "", stmt.lineno)
                ended = ended or isinstance(stmt, ENDS)
        super().visit(node)

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            self.add("import", a.asname or a.name.split(".")[0], node.lineno, detail=a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        for a in node.names:
            if a.name == "*":
                self.add("dynamic")
            else:
                self.add("import", a.asname or a.name, node.lineno, detail="." * node.level + (node.module or ""))

    def visit_Name(self, node: ast.Name) -> None:  # noqa: N802
        self.add("use", node.id, node.lineno)
        for scope in self.scopes():
            self.add("load" if isinstance(node.ctx, ast.Load) else "store", node.id, node.lineno, scope)

    def visit_Constant(self, node: ast.Constant) -> None:  # noqa: N802
        if isinstance(node.value, str):
            self.add("string", node.value[:200], node.lineno)

    def visit_Assign(self, node: ast.Assign) -> None:  # noqa: N802
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            self.add("dynamic")
            for c in ast.walk(node.value):
                if isinstance(c, ast.Constant) and isinstance(c.value, str):
                    self.add("exported", c.value.split(".")[0], node.lineno)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        f, name = node.func, ""
        if isinstance(f, ast.Name):
            name = f.id
            costly = name in COSTLY_NAMES
        elif isinstance(f, ast.Attribute):
            name, receiver = f.attr, f.value.id if isinstance(f.value, ast.Name) else ""
            costly = receiver not in INSPECTORS and name in COSTLY_METHODS
            if name in ("get", "post") and receiver in NETWORK:
                name, costly = f"{receiver}.{name}", True
        else:
            costly = False
        if name in DYNAMIC_CALLS:
            self.add("dynamic")
        if costly and self.loops:
            self.add("loop-call", name, node.lineno)
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:  # noqa: N802
        if self.loops and isinstance(node.op, ast.Add) and isinstance(node.target, ast.Name) and not isinstance(node.value, (ast.Name, ast.Constant)):
            self.add("accumulate", node.target.id, node.lineno, detail=str(self.loops[-1].lineno))
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:  # noqa: N802
        t = node.test
        if isinstance(t, ast.Compare) and isinstance(t.left, ast.Name) and t.left.id == "__name__":
            self.add("main-guard", line=node.lineno)
        self.generic_visit(node)

    def _loop(self, node: ast.AST) -> None:
        if self.loops:
            self.add("nested-loop", line=self.loops[-1].lineno)
        self.loops.append(node)
        self.generic_visit(node)
        self.loops.pop()

    visit_For = visit_AsyncFor = visit_While = _loop  # noqa: N815

    def _define(self, node: ast.AST) -> None:
        self.add("def", node.name, node.lineno, detail="class" if isinstance(node, ast.ClassDef) else "function", n=len(node.decorator_list))
        if isinstance(node, FUNCTIONS):
            score, depth = self.measure(node)
            scope = f"{node.name}:{node.lineno}"
            for kind, n in (("cyclomatic", score), ("nesting", depth), ("length", (node.end_lineno or node.lineno) - node.lineno + 1), ("parameters", len(node.args.args) + len(node.args.kwonlyargs))):
                self.add(kind, node.name, node.lineno, scope, n=n)
            for a in [*node.args.args, *node.args.kwonlyargs]:
                self.add("parameter", a.arg, node.lineno, scope)
            loops, self.loops = self.loops, []
            self.functions.append(node)
            self.generic_visit(node)
            self.functions.pop()
            self.loops = loops
        else:
            self.generic_visit(node)

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _define  # noqa: N815

    @staticmethod
    def measure(function: ast.AST) -> tuple[int, int]:
        """(1 + branches, deepest nesting of blocks; a definition inside starts anew)."""
        score, deepest, level = 1, 0, [(function, 0)]
        while level:
            node, depth = level.pop()
            score += isinstance(node, BRANCHES)
            depth = 0 if isinstance(node, (*FUNCTIONS, ast.ClassDef)) else depth + isinstance(node, LEVELS)
            deepest = max(deepest, depth)
            level += [(c, depth) for c in ast.iter_child_nodes(node) if not isinstance(c, BARE)]
        return score, deepest


def python_facts(texts: DataFrame) -> DataFrame:
    """(path, text) -> facts of the Python files. Each file is parsed once, where it lies; a file that doesn't parse gives one
    row of kind broken. A parser has no form in SQL."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FACTS, strict=True)], schema=_FACTS)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at in range(0, b.num_rows, HELD_FILES):
                yield from zip(*(c.to_pylist() for c in b.slice(at, HELD_FILES).columns), strict=True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for path, text in files(batches):
            if len(out) >= FACT_ROWS:  # rows go out as they come, however many files a batch has
                yield made(out)
                out = []
            try:
                v = Facts()
                v.visit(ast.parse(text or ""))
                lower = (text or "").lower()
                if any(w in lower for w in DYNAMIC_WORDS):
                    v.add("dynamic")
                out += [(path, *r) for r in v.rows]
            except (SyntaxError, ValueError, RecursionError):
                out.append((path, "broken", "", 0, "", "", 0))
        if out:
            yield made(out)

    return texts.where(exprs.language(F.col("path")) == "python").select("path", "text").mapInArrow(parse, FACTS)


def _of(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("kind").isin(*kinds))


def _finding(rows: DataFrame, category: str, title, confidence, impact: str = "LOW", effort: str = "SMALL", risk="LOW") -> DataFrame:
    lit = lambda x: x if isinstance(x, F.Column) else F.lit(x)
    return rows.select("path", "line", "name", F.lit(category).alias("category"), lit(title).alias("title"), lit(confidence).alias("confidence"), lit(impact).alias("impact"), lit(effort).alias("effort"), lit(risk).alias("risk"))


def unused_imports(facts: DataFrame) -> DataFrame:
    """Bindings that no name in the module uses and that it doesn't export. Of a name bound twice the last counts."""
    bound = _of(facts, "import").groupBy("path", "name").agg(F.max(F.struct("line", "detail")).alias("b")).select("path", "name", "b.line", "b.detail").where("detail <> '__future__'")
    rows = bound.join(_of(facts, "use", "exported").select("path", "name").distinct(), ["path", "name"], "left_anti")
    return _finding(rows, "DEAD_CODE", F.concat(F.lit("Unused import `"), "name", F.lit("`")), "HIGH")


def unreachable(facts: DataFrame) -> DataFrame:
    rows = _of(facts, "unreachable").select("path", "line", F.lit("").alias("name")).distinct()
    return _finding(rows, "DEAD_CODE", F.concat(F.lit("Unreachable statement (line "), F.col("line").cast("string"), F.lit(")")), "HIGH")


def unused_locals(facts: DataFrame) -> DataFrame:
    """Names stored and never loaded in a function; parameters and names with an underscore are left out."""
    stored = _of(facts, "store").where("not startswith(name, '_')").groupBy("path", "scope", "name").agg(F.min("line").alias("line"))
    rows = stored.join(_of(facts, "load", "parameter").select("path", "scope", "name").distinct(), ["path", "scope", "name"], "left_anti")
    return _finding(rows, "DEAD_CODE", F.concat(F.lit("Unused local variable `"), "name", F.lit("` in `"), F.split_part("scope", F.lit(":"), F.lit(1)), F.lit("`")), "MEDIUM")


def unused_definitions(facts: DataFrame) -> DataFrame:
    """Definitions that no module's names refer to; only possible where a module is public, dynamic, decorated or a test."""
    defined = _of(facts, "def").groupBy("path", "name").agg(F.max(F.struct("line", "detail", "n")).alias("d")).select("path", "name", "d.line", "d.detail", "d.n")
    dynamic = _of(facts, "dynamic").select("path", F.lit(True).alias("dynamic")).distinct()
    used = _of(facts, "use", "import").select("name").distinct()
    public = ~F.col("name").startswith("_")
    test = F.element_at(F.split("path", "/"), -1).rlike("^test_|_test\\.py$") | F.col("path").rlike("(^|/)tests?/")
    rows = defined.join(used, "name", "left_anti").join(dynamic, "path", "left").where(~F.col("name").isin(ENTRY_POINTS) & ~(public & F.coalesce("dynamic", F.lit(False))))
    unsure = public | test | (F.col("n") > 0) | F.coalesce("dynamic", F.lit(False))
    title = F.concat(F.when(unsure, "Potentially unused ").otherwise("Unused "), "detail", F.lit(" `"), "name", F.lit("`"))
    return _finding(rows, "DEAD_CODE", title, F.when(unsure, "LOW").otherwise("MEDIUM"), risk="MEDIUM")


def complexity(facts: DataFrame) -> DataFrame:
    """Functions over the branch threshold, or over two of the four."""
    limits = {"cyclomatic": CYCLOMATIC, "nesting": NESTING, "length": LENGTH, "parameters": PARAMETERS}
    wide = _of(facts, *limits).groupBy("path", "scope", "name", "line").pivot("kind", list(limits)).agg(F.max("n"))
    over = sum((F.when(F.col(k) >= v, 1).otherwise(0) for k, v in limits.items()), F.lit(0))
    return wide.where((over >= 2) | (F.col("cyclomatic") >= CYCLOMATIC))


def loop_costs(facts: DataFrame) -> DataFrame:
    """Costly calls and accumulation in loops, and loops in loops."""
    calls = _finding(_of(facts, "loop-call").select("path", "line", "name").distinct(), "EFFICIENCY", F.concat(F.lit("Repeated `"), "name", F.lit("` inside loop (line "), F.col("line").cast("string"), F.lit(")")), "MEDIUM", "MEDIUM")
    grown = _of(facts, "accumulate").groupBy("path", "detail").agg(F.min(F.struct("line", "name")).alias("a")).select("path", "a.line", "a.name")
    grown = _finding(grown, "EFFICIENCY", F.concat(F.lit("String/list accumulation with `+=` in loop (`"), "name", F.lit("`)")), "LOW")
    nested = _finding(_of(facts, "nested-loop").select("path", "line", F.lit("").alias("name")).distinct(), "EFFICIENCY", F.concat(F.lit("Nested loops (line "), F.col("line").cast("string"), F.lit(") — quadratic shape")), "LOW", "MEDIUM", "MEDIUM")
    return calls.union(grown).union(nested)


def dependency_use(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared packages that no module imports, by their own name or that of their import, and no string names: anti-joins on
    normalised names."""
    imports = _of(facts, "import").select(exprs.package_name(F.split_part("detail", F.lit("."), F.lit(1))).alias("key")).distinct()
    strings = _of(facts, "string").select(exprs.package_name(F.col("name")).alias("key")).distinct()
    alias = F.create_map(*[F.lit(x) for pair in IMPORT_NAMES.items() for x in pair])
    rows = declared.withColumn("key", exprs.package_name(F.col("name"))).withColumn("other", F.coalesce(F.try_element_at(alias, F.col("key")), F.col("key")))
    return rows.join(imports, "key", "left_anti").join(imports.withColumnRenamed("key", "other"), "other", "left_anti").join(strings, "key", "left_anti").drop("key", "other")


def import_edges(facts: DataFrame) -> DataFrame:
    """(source, target): modules that import each other."""
    return resolved_imports(facts).where("source <> target")


def call_edges(facts: DataFrame) -> DataFrame:
    """(source, target, confidence): uses of names that another module defines (the first by path), high if it imports that module."""
    owner = _of(facts, "def").groupBy("name").agg(first_path("path").alias("target"))
    uses = _of(facts, "use").select(F.col("path").alias("source"), "name").distinct().join(owner, "name").where("source <> target").select("source", "target").distinct()
    return uses.join(import_edges(facts).withColumn("backed", F.lit(True)), ["source", "target"], "left").select("source", "target", F.when(F.col("backed"), "HIGH").otherwise("MEDIUM").alias("confidence"))


def orphans(facts: DataFrame) -> DataFrame:
    """Modules that nothing imports, that have no main guard and aren't tests or package files."""
    modules = facts.select("path").distinct().where(~F.col("path").rlike("(^|/)(__init__|__main__|setup|conftest|test_[^/]*|[^/]*_test)\\.py$"))
    return modules.join(import_edges(facts).select(F.col("target").alias("path")), "path", "left_anti").join(_of(facts, "main-guard").select("path"), "path", "left_anti")


#: Calls in scripts that are worth a look, and most of them in a file. Fixed values.
SCRIPT_CALLS, MOST_CALLS = r"\b(JSON\.parse|JSON\.stringify|fetch|require)\s*\(", 11


def script_costs(texts: DataFrame, most: int | None = MOST_CALLS) -> DataFrame:
    """Call sites in scripts that may cost, the first of each file (None: all)."""
    rows = texts.where(exprs.language(F.col("path")) == "javascript").select("path", F.posexplode(F.split("text", "\n")).alias("at", "content"))
    calls = rows.select("path", (F.col("at") + 1).alias("line"), F.posexplode(F.regexp_extract_all("content", F.lit(SCRIPT_CALLS), F.lit(1))).alias("n", "name"))
    first = calls if most is None else limit_per(calls, ["path"], ["line", "n"], most)
    return _finding(first, "EFFICIENCY", F.concat(F.lit("Potentially repeated `"), "name", F.lit("` (line "), F.col("line").cast("string"), F.lit(")")), "LOW")


def project_findings(texts: DataFrame, facts: DataFrame, declared: DataFrame) -> DataFrame:
    """Findings of the project as a whole: dependencies that nothing uses, modules that nothing imports, configuration files of one concern."""
    unused = dependency_use(facts, declared).where(~F.col("name").isin(STANDARD)).select("path", F.lit(0).alias("line"), "name")
    unused = _finding(unused, "DEPENDENCY", F.concat(F.lit("Possibly unused dependency `"), "name", F.lit("`")), "LOW", risk="MEDIUM")
    lone = orphans(facts).select("path", F.lit(0).alias("line"), stem_of(F.col("path")).alias("name"))
    lone = _finding(lone, "STRUCTURE", F.concat(F.lit("Possibly orphaned module `"), "path", F.lit("`")), "LOW", risk="MEDIUM")
    twice = overlapping_configs(texts).select(F.split_part("files", F.lit(","), F.lit(1)).alias("path"), F.lit(0).alias("line"), F.lit("").alias("name"), "files")
    return unused.union(lone).union(_finding(twice, "CONFIGURATION", F.concat(F.lit("Overlapping configuration: "), "files"), "MEDIUM"))


def analyse(facts: DataFrame, texts: DataFrame | None = None, declared: DataFrame | None = None, most_calls: int | None = MOST_CALLS, most_blocks: int | None = duplication.MOST) -> DataFrame:
    """All findings, scored, labelled and ranked; with texts those of scripts and repeated blocks too, with declared packages as well those of the project.
    Limits: call sites of a script, repeated blocks; None lifts one."""
    hard = complexity(facts).select("path", "line", "name", F.lit("COMPLEXITY").alias("category"), F.concat(F.lit("Complex function `"), "name", F.lit("`")).alias("title"), F.lit("HIGH").alias("confidence"),
                                    F.when(F.col("cyclomatic") >= 2 * CYCLOMATIC, "MEDIUM").otherwise("LOW").alias("impact"), F.lit("MEDIUM").alias("effort"), F.lit("MEDIUM").alias("risk"))
    every = unused_imports(facts).union(unreachable(facts)).union(unused_locals(facts)).union(unused_definitions(facts)).union(loop_costs(facts)).union(hard)
    if texts is not None:
        unused = scripts.unused_definitions(texts)
        unused = _finding(unused, "DEAD_CODE", F.concat(F.lit("Potentially unused symbol `"), "name", F.lit("`")), "LOW", risk="MEDIUM")
        blocks = duplication.findings(texts.where(exprs.language(F.col("path")).isin("python", "javascript")), most_blocks)
        every = every.union(script_costs(texts, most_calls)).union(unused).union(blocks.select(*every.columns))
        every = every if declared is None else every.union(project_findings(texts, facts, declared))
    value = exprs.code_score(*map(F.col, ("confidence", "impact", "effort", "risk")))
    scored = every.withColumn("score", value).withColumn("label", exprs.code_label(F.col("score"), *map(F.col, ("confidence", "impact", "effort", "risk"))))
    return scored.withColumn("id", exprs.digest("c", 11, F.lower("category"), F.col("category"), F.col("path"), F.col("line"), F.col("name"), F.col("title"))).orderBy(F.desc("score"), "path", "line", "id")


def javascript_facts(texts: DataFrame) -> DataFrame:
    """(path, kind, name) of imports, exports and definitions in scripts, by pattern."""
    rows = texts.where(exprs.language(F.col("path")) == "javascript")
    patterns = {"import": r"(?:from\s+|require\(|import\s+)[\"']([^\"']+)[\"']", "export": r"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+([A-Za-z_$][\w$]*)", "def": r"(?:function|class|const|let|var)\s+([A-Za-z_$][\w$]*)"}
    out = None
    for kind, p in patterns.items():
        found = rows.select("path", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).alias("name"))
        out = found if out is None else out.union(found)
    return out
