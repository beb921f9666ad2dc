"""Keyword search over texts, and context within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def occurrences(text: Column, term: str) -> Column:
    """How often a term stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def search(notes: DataFrame, query: str, n: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) -> (score, path, snippet): 3 for each term in the path, 1 for each occurrence in the text; the first line with
    a term is the snippet; the n best, all columns descending. Columns named in carry come along."""
    terms = query.lower().split()
    low = F.lower("text")
    score = sum((F.when(F.lower("path").contains(t), 3).otherwise(0) + occurrences(low, t) for t in terms), F.lit(0)).cast("long")
    has = lambda line: F.array_max(F.array(*[F.lower(line).contains(t) for t in terms]))
    line = F.coalesce(F.get(F.filter(F.split("text", "\n"), has), F.lit(0)), F.lit(""))
    snippet = F.substring(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), 1, 160)
    found = notes.select(score.alias("score"), "path", snippet.alias("snippet"), *carry).where("score > 0")
    return found.orderBy(F.desc("score"), F.desc("path"), F.desc("snippet")).limit(max(1, n))


def within_budget(ranked: DataFrame, order: list[str], text: str, budget: int) -> DataFrame:
    """Texts in order until the budget of characters is spent, the last one cut. The rows are the few that a search returned."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(budget) - before)
    return ranked.withColumn("chunk", F.substring(F.col(text), F.lit(1), left.cast("int"))).where(F.length("chunk") > 0)


def context(notes: DataFrame, task: str, max_chars: int = 4000, n: int = 5, body_chars: int = 1500) -> DataFrame:
    """(place, path, chunk) of the notes that a task's words find, best first: heading and the text's first `body_chars`
    characters, until `max_chars`, the task's heading included, are spent."""
    found = search(notes, task, n, ("text",))
    ranked = found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("path"), F.desc("snippet"))))
    whole = F.concat(F.lit("\n## "), "path", F.lit("\n"), F.substring("text", 1, body_chars), F.lit("\n"))
    left = max(0, max_chars - len(f"# Task\n{task}\n"))
    return within_budget(ranked.withColumn("whole", whole), ["place"], "whole", left).select("place", "path", "chunk")
