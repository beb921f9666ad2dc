"""Remediation options of code findings, and the tasks of a plan for one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import fixed

#: (category, option, title, description, risk, complexity, automation, advantages, disadvantages); {s} is the symbol or "the flagged code",
#: {t} the symbol or the file, {f} the file. The empty category is any other. Fixed values.
OPTIONS = [
    ("DEAD_CODE", "delete", "Delete {s}", "Remove {s} from {f}. Simplest; lowest maintenance.", "", "SMALL", "SAFE_WITH_TESTS",
     ["Smallest diff", "No ongoing maintenance", "Removes code that need not exist"], ["Breaks dynamic/config references if verification was skipped"]),
    ("DEAD_CODE", "retain-document", "Retain and document {s}", "Keep {s} as intentional API/surface; add an explicit export, reference, or docstring explaining why it exists.", "LOW", "SMALL", "MANUAL",
     ["Zero breakage risk", "Converts unknown-unknown into documented surface"], ["Keeps maintenance cost", "Does not reduce size"]),
    ("DEAD_CODE", "quarantine", "Quarantine behind an explicit marker", "Move the symbol to a clearly-marked compatibility module with a removal date.", "LOW", "MEDIUM", "MANUAL",
     ["Unblocks cleanup without deletion", "Forces a revisit decision"], ["Adds a module", "Only defers the choice"]),
    ("DUPLICATION", "extract-helper", "Extract a shared helper", "Move the repeated block into one helper; call it from each site.", "MEDIUM", "MEDIUM", "REQUIRES_REVIEW",
     ["Single source of truth", "Fixes propagate once"], ["Wrong abstraction merges distinct behaviors", "Needs careful parameter naming"]),
    ("DUPLICATION", "partial-share", "Share constants/config only", "Keep logic separate; extract only the repeated data or configuration.", "LOW", "SMALL", "SAFE_WITH_TESTS",
     ["Low risk", "Removes the most brittle drift"], ["Logic duplication remains"]),
    ("DUPLICATION", "keep-as-is", "Keep as-is (documented)", "Leave the duplication; note why (different owners, pending divergence).", "LOW", "TRIVIAL", "MANUAL",
     ["No churn", "Honest about trade-offs"], ["Drift risk remains"]),
    ("EFFICIENCY", "hoist-cache", "Hoist / cache the repeated work", "Move loop-invariant computation out of the loop or cache the parsed result.", "LOW", "SMALL", "SAFE_WITH_TESTS",
     ["Removes repeated cost", "Usually a small diff"], ["Caching adds state; hoisting changes evaluation timing"]),
    ("EFFICIENCY", "restructure", "Restructure the data flow", "Change shapes (sets/dicts, early exits, batching) instead of micro-fixes.", "MEDIUM", "MEDIUM", "REQUIRES_REVIEW",
     ["Addresses the real complexity", "Often simplifies code too"], ["Larger diff", "Needs profiling to justify"]),
    ("EFFICIENCY", "keep-as-is", "Keep as-is (measured)", "Profile first; if the path is cold, document and move on.", "LOW", "TRIVIAL", "MANUAL",
     ["No risk", "Avoids premature optimization"], ["Leaves the cost in place"]),
    ("DEPENDENCY", "remove-dep", "Remove dependency `{s}`", "Drop `{s}` from {f}, reinstall, run the full suite.", "MEDIUM", "SMALL", "SAFE_WITH_TESTS",
     ["Smaller installs", "Less supply-chain surface"], ["Breaks optional/dynamic usage missed by static scan"]),
    ("DEPENDENCY", "mark-optional", "Mark as optional / lazy-load", "Move to extras/optional and import lazily at the use site.", "LOW", "MEDIUM", "REQUIRES_REVIEW",
     ["Keeps the capability", "Cheaper default install"], ["More packaging complexity"]),
    ("", "simplify", "Simplify `{t}`", "Split, flatten, or reorganize per the finding evidence; keep behavior identical.", "MEDIUM", "MEDIUM", "REQUIRES_REVIEW",
     ["Easier review and fewer defects", "Often removes hidden duplication"], ["Refactor churn", "Needs full test pass"]),
    ("", "keep-as-is", "Keep as-is (documented)", "Complexity may be inherent; record the observation and revisit on next touch.", "LOW", "TRIVIAL", "MANUAL",
     ["No risk", "No churn"], ["Cost stays"]),
]
#: Constraints that a user may set, and the task that some of them add. Fixed values.
CONSTRAINTS = ["preserve-public-apis", "minimize-files", "minimize-behavior-change", "prioritize-performance", "prioritize-readability", "prioritize-maintainability",
               "preserve-backward-compat", "no-new-dependencies", "no-arch-changes", "preserve-tests", "require-tests", "minimize-runtime-risk"]
CONSTRAINT_TASKS = {
    "require-tests": "Add or update tests covering the changed behavior before modifying code.",
    "preserve-tests": "Run the existing test suite before and after; every previously-passing test must still pass.",
    "no-new-dependencies": "Implement using stdlib / already-installed dependencies only.",
    "preserve-public-apis": "Keep every public name importable with identical signatures.",
}
#: What tells that a finding is gone, where it says nothing itself. Fixed value.
CHECK = "Re-run analysis; finding must be gone."
#: Order of the parts of an affected surface in a plan, and beginnings of paths that are routes. Fixed values.
SURFACE = ["DIRECTLY_AFFECTED", "CONFIGURATION_AFFECTED", "TEST_AFFECTED", "INDIRECTLY_AFFECTED", "DEPENDENCY_AFFECTED", "API_AFFECTED", "OPTIONAL_REVIEW"]
VERBS = r"^(GET|POST|PUT|DELETE|PATCH) "


def _filled(text: Column, symbol: Column, file: Column) -> Column:
    for mark, value in (("{s}", F.when(symbol == "", "the flagged code").otherwise(symbol)), ("{t}", F.when(symbol == "", file).otherwise(symbol)), ("{f}", file)):
        text = F.replace(text, F.lit(mark), value)
    return text


def options(findings: DataFrame) -> DataFrame:
    """(id, path, name, option, title, description, risk, complexity, automation, advantages, disadvantages): two or three for each code
    finding (id, path, name, category, confidence), by category: a join with a table of fixed size."""
    fields = "category string, option string, title string, description string, risk string, complexity string, automation string, advantages array<string>, disadvantages array<string>"
    table = fixed(findings.sparkSession, OPTIONS, fields)
    known = [c for c in dict.fromkeys(o[0] for o in OPTIONS) if c]
    rows = findings.select("id", "path", "name", "confidence", F.when(F.col("category").isin(known), F.col("category")).otherwise("").alias("category"))
    symbol, file = F.coalesce("name", F.lit("")), F.col("path")
    risk = F.when(F.col("option") == "delete", F.when(F.col("confidence") == "LOW", "MEDIUM").otherwise("LOW")).otherwise(F.col("risk"))
    return rows.join(F.broadcast(table), "category").select("id", "path", "name", "option", _filled(F.col("title"), symbol, file).alias("title"), _filled(F.col("description"), symbol, file).alias("description"),
                                                            risk.alias("risk"), "complexity", "automation", "advantages", "disadvantages")


def plan_tasks(chosen: DataFrame, constraints: list[str] | None = None) -> DataFrame:
    """(id, place, title, what, why, files, expected, verify): the tasks of each chosen option: confirm, apply, one for each constraint that has one (last
    name first), test. chosen may have the finding's verification and rationale, and the files affected; else the option's own texts and path stand for them."""
    wanted = sorted(set(constraints or []))
    if unknown := [c for c in wanted if c not in CONSTRAINTS]:
        raise ValueError(f"unknown constraints: {unknown}")
    given = lambda name, other: F.coalesce(F.when(F.col(name) != "", F.col(name)), other) if name in chosen.columns else other
    check, reason = given("verification", F.lit(CHECK)), given("rationale", F.col("description"))
    files = F.coalesce("files", F.array("path")) if "files" in chosen.columns else F.array("path")
    text = lambda x: x if isinstance(x, Column) else F.lit(x)

    def task(title, what, why, where, expected, *verify) -> Column:
        row = zip(("title", "what", "why", "files", "expected", "verify"), (title, what, why, where, expected, F.array(*map(text, verify))), strict=True)
        return F.struct(*[text(v).alias(k) for k, v in row])

    extra = [task(f"Constraint: {c}", CONSTRAINT_TASKS[c], "User-selected constraint.", files, "Constraint honored.", f"Reviewer confirms: {c}.") for c in reversed(wanted) if c in CONSTRAINT_TASKS]
    changed = F.concat(F.lit("Change applied to "), F.array_join(files, ", "), F.lit("; nothing else touched."))
    tasks = F.array(task("Confirm the finding", F.concat(F.lit("Verify: "), check), "Never remediate an unconfirmed finding.", F.slice(files, 1, 1), "Finding confirmed or rejected with evidence.", check),
                    task(F.concat(F.lit("Apply: "), "title"), F.col("description"), reason, files, changed, check), *extra,
                    task("Run tests and re-analyze", "Run the project's test suite, then re-run the code analysis on the touched files.", "Behavior must be preserved; the finding must be gone.", files,
                         "Tests pass; finding no longer reported.", "Test suite green.", "Verification reports RESOLVED."))
    return chosen.select("id", F.posexplode(tasks).alias("at", "t")).select("id", (F.col("at") + 1).alias("place"), "t.*")


def rejected_options(options_: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, option): the options of each finding with a plan that were not chosen."""
    return options_.join(chosen.select("id").distinct(), "id", "left_semi").select("id", "option").join(chosen.select("id", "option"), ["id", "option"], "left_anti")


def plan_files(surface: DataFrame) -> DataFrame:
    """(id, place, path): files of a plan from an affected surface (id, bucket, path, relation): by bucket, each path once, no routes and
    nothing that only belongs to the same part."""
    order = F.array_position(F.array(*map(F.lit, SURFACE)), F.col("bucket"))
    rows = surface.where((F.col("path") != "") & ~F.col("path").rlike(VERBS) & (order > 0)).groupBy("id", "path").agg(F.min(F.struct(order.alias("o"), "path", "relation")).alias("b"))
    listed = rows.where("b.relation <> 'BELONGS_TO'").groupBy("id").agg(F.array_sort(F.collect_list("b")).alias("files"))
    return listed.select("id", F.posexplode("files").alias("at", "f")).select("id", (F.col("at") + 1).alias("place"), "f.path")


def markdown(tasks: DataFrame) -> DataFrame:
    """(id, text): a plan's tasks as a numbered list."""
    line = F.concat(F.col("place").cast("string"), F.lit(". **"), "title", F.lit("**: "), "what")
    return tasks.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
