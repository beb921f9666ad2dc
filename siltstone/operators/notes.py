"""Small text operators: key-value notes, repository addresses, image configuration, headers, plan checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headers whose values are never shown, names of variables that hold secrets. Fixed values.
HIDDEN_HEADERS = ["authorization", "cookie", "set-cookie", "proxy-authorization", "x-api-key"]
SECRET_NAME = r"(?i)(password|passwd|secret|token|private|credential)"


#: Assignments of secrets and beginnings of private keys in notes, and names of files that are never written. Fixed values.
SECRET_LINE = r"(?i)\b(api[_-]?key|password|passwd|secret|token|private[_-]?key|auth|cookie|session[_-]?key|client[_-]?secret)\b\s*[:=]\s*\S+"
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
SECRET_FILES = [".env", ".pem", ".key", "id_rsa", "id_ed25519", "credentials", "secrets", "token", "cookie"]


def redacted_note(text: Column) -> Column:
    """A note without values of secrets and private keys."""
    return F.regexp_replace(F.regexp_replace(text, SECRET_LINE, "[REDACTED: sensitive configuration omitted]"), KEY_BLOCK, "[REDACTED: private key omitted]")


def one_line(text: Column, limit: int = 160) -> Column:
    """White space collapsed, cut to the limit."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""), 1, limit)


def note_slug(text: Column) -> Column:
    """Name of a note's file."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    clean = F.regexp_replace(cut, "^-+|-+$", "")
    return F.when(clean == "", "note").otherwise(clean)


def note_writes(notes: DataFrame, stored: DataFrame, overwrite: bool = False) -> DataFrame:
    """(path, action, text) of notes (path, text) to be written beside those stored: created, unchanged, updated, or refused: names of
    secret files, and others than stored unless overwrite."""
    secret = F.lower("path").rlike("|".join(x.replace(".", r"\.") for x in SECRET_FILES))
    both = notes.select("path", redacted_note(F.col("text")).alias("text")).join(stored.select("path", F.col("text").alias("old")), "path", "left")
    action = F.when(secret, "refused").when(F.col("old").isNull(), "created").when(F.col("old") == F.col("text"), "unchanged").otherwise("updated" if overwrite else "refused")
    return both.select("path", action.alias("action"), "text")


def key_values(notes: DataFrame) -> DataFrame:
    """(path, text) -> (path, key, value) of `key = value` lines, the first of a key."""
    rows = notes.select("path", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(r"^\s*[\w.-]+\s*="))
    pairs = rows.select("path", "at", F.regexp_extract("line", r"^\s*([\w.-]+)\s*=", 1).alias("key"), F.trim(F.regexp_extract("line", r"=(.*)$", 1)).alias("value"))
    return pairs.groupBy("path", "key").agg(F.min_by("value", "at").alias("value"))


def links(notes: DataFrame) -> DataFrame:
    """(path, target) of [[wiki]] links."""
    return notes.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)"), F.lit(1)))).alias("target"))


def repository(url: Column) -> Column:
    """Owner, name and reference of a repository's web address; null if it is none: only https, the one host, no credentials or port."""
    clean = F.regexp_replace(F.trim(url), "/+$", "")
    p = r"^https://(?:www\.)?github\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]{1,100}?)(?:\.git)?(?:/(?:tree|commit)/([A-Za-z0-9._/-]+))?$"
    ref = F.regexp_extract(clean, p, 3)
    name = F.regexp_extract(clean, p, 2)
    good = clean.rlike(p) & ~name.isin("", ".", "..") & ~ref.contains("..")
    return F.when(good, F.struct(F.regexp_extract(clean, p, 1).alias("owner"), name.alias("name"), F.when(ref != "", ref).alias("ref")))


def secret_variables(configs: DataFrame) -> DataFrame:
    """(path, config JSON of an image) -> (path, name) of environment variables whose name looks like a secret; values never leave."""
    env = F.from_json("config", "struct<config: struct<Env: array<string>>>")
    names = configs.select("path", F.explode(env["config"]["Env"]).alias("e")).select("path", F.split_part("e", F.lit("="), F.lit(1)).alias("name"))
    return names.where(F.col("name").rlike(SECRET_NAME)).distinct()


def shown_headers(headers: Column) -> Column:
    """A map of headers without the values of those that carry credentials."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(HIDDEN_HEADERS), "[REDACTED]").otherwise(v))


def short_path(path: Column, keep: int = 3) -> Column:
    """The last parts of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= keep, path).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -keep, keep), "/")))


def line_label(line: Column) -> Column:
    return F.when(line > 0, F.concat(F.lit("L"), line.cast("string"))).otherwise("")


def missing_files(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path) of a plan's files that the graph doesn't have."""
    return plan.select("path").distinct().join(nodes.select("path"), "path", "left_anti")
