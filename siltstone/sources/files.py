"""File sources: text and configuration files, binaries, archives, manifests, certificates."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import exprs
from siltstone.operators.notes import secret_variables

#: Limits of a scan and names that it passes over. Fixed values; limits are options that may be lifted.
MAX_FILES, MAX_BYTES, MAX_MANIFESTS, SNIFF = 2000, 512 * 1024, 200, 8192
SKIPPED = [".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".idea", "vendor", "target", "out", "coverage", ".next", ".nuxt", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache"]
TEXT_SUFFIXES = ["py", "js", "ts", "jsx", "tsx", "java", "go", "rs", "c", "h", "cpp", "cs", "rb", "php", "yaml", "yml", "toml", "ini", "cfg", "conf", "json", "xml", "properties", "env", "pem", "crt", "key", "cnf", "sh", "ps1", "tf", "dockerfile"]
#: First bytes of executables (ELF, PE, Mach-O in its forms). Fixed values.
MAGIC = ["7F454C46", "4D5A", "CFFAEDFE", "CEFAEDFE", "FEEDFACE", "FEEDFACF", "CAFEBABE", "CAFEBABF"]
MAX_STRINGS, PEEK, MAX_LAYERS, MAX_MEMBERS, LAYER_BUDGET = 20_000, 64 * 1024, 10, 2000, 64 << 20


def listing(spark: SparkSession, root: str, *, max_bytes: int | None = MAX_BYTES, skipped: list[str] | None = None, languages: list[str] | None = None, since=None) -> DataFrame:
    """(path, length, modified) of the files under a folder, from names and sizes alone: no content is read. Left out are skipped folders, symbolic
    links and what lies behind them, empty files (Spark lists none), files of more than max_bytes (None: none), of other languages, and those not modified
    after `since`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    found = found if max_bytes is None else found.where(F.col("length") <= max_bytes)
    found = found if since is None else found.where(F.col("modified") > F.lit(since))
    parts = F.split("path", "/")
    found = found.where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED if skipped is None else skipped))))
    found = found if languages is None else found.where(exprs.language(F.col("path")).isin(languages))
    return found.where(~_behind_link(root)(F.col("path")))


def _behind_link(root: str):
    """Whether a file of a local folder is a symbolic link or lies behind one; stores without links have none."""
    local = lambda p: re.sub("^file:(//)?(?=/)", "", p)
    top = local(root).rstrip("/")

    def linked(p: str) -> bool:
        p = local(p)
        return p.startswith(top + "/") and os.path.realpath(p) != os.path.join(os.path.realpath(top), p[len(top) + 1 :])

    @F.pandas_udf("boolean")
    def behind(path: pd.Series) -> pd.Series:
        return path.map(linked).astype(bool)

    return behind.asNondeterministic()  # so that a join does not copy the condition to the side that holds contents


def contents(spark: SparkSession, root: str, listed: DataFrame, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, content, length) of listed files. Size and skipped folders are conditions on the files' own metadata, so that the scan never opens
    what they rule out; the listing settles the rest by a semi-join."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = found if max_bytes is None else found.where(F.col("length") <= max_bytes)
    folders = "|".join(re.escape(n) for n in SKIPPED)
    found = found.where(~F.col("_metadata.file_path").rlike(f"/({folders})/")).select("path", "content", "length")
    return found.join(listed.select("path"), "path", "left_semi")


def files(spark: SparkSession, root: str, *, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, content, length) of the files under a folder: those listed, the first max_files by component-wise path order (None: all)."""
    listed = listing(spark, root, max_bytes=max_bytes)
    if max_files is not None:
        listed = listed.select("path").orderBy(F.split("path", "/")).limit(max_files)
    return contents(spark, root, listed, max_bytes)


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) between two listings: added, removed, or modified by length or time; a full join by path."""
    old = before.select("path", F.col("length").alias("l"), F.col("modified").alias("m"), F.lit(True).alias("was"))
    both = now.select("path", "length", "modified", F.lit(True).alias("is")).join(old, "path", "full")
    same = (F.col("length") == F.col("l")) & (F.col("modified") == F.col("m"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~same, "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def is_text(path: Column, content: Column) -> Column:
    """A known suffix, or no NUL byte near the beginning."""
    suffix = F.lower(F.regexp_extract(path, r"\.?([^./]+)$", 1))
    return F.when(suffix.isin(TEXT_SUFFIXES), True).otherwise(F.instr(F.decode(F.substring(content, 1, SNIFF), "ISO-8859-1"), "\0") == 0)


def texts(found: DataFrame) -> DataFrame:
    """(path, text) of the text files."""
    return found.where(is_text(F.col("path"), F.col("content"))).select("path", F.decode("content", "UTF-8").alias("text"))


def binary_strings(found: DataFrame, most: int | None = MAX_STRINGS) -> DataFrame:
    """(path, place, content): printable ASCII runs of four and more in executables, the first `most` of a file (None: all)."""
    is_binary = F.lit(False)
    for m in MAGIC:
        is_binary = is_binary | (F.hex(F.substring("content", 1, len(m) // 2)) == m)
    runs = F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(r"([\x20-\x7e]{4,})"), F.lit(1))
    return found.where(is_binary).select("path", F.posexplode(runs if most is None else F.slice(runs, 1, most)).alias("place", "content"))


def manifests(found: DataFrame, names: list[str], most: int | None = MAX_MANIFESTS) -> DataFrame:
    """The first `most` dependency manifests by path (None: all)."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    picked = found.where(name.isin(names) | name.startswith("requirements"))
    if most is None:
        return picked
    return picked.join(picked.select("path").orderBy(F.split("path", "/")).limit(most), "path", "left_semi")


def _read(stream, most: int | None) -> bytes:
    return stream.read() if most is None else stream.read(max(0, most))


def _layer(stream, above: str, most: int | None, peek: int | None, budget: int | None) -> Iterator[tuple[str, bytes]]:
    """Regular members of a tar stream, plain or packed, in order, until it breaks off."""
    left = budget
    try:
        with tarfile.open(fileobj=stream, mode="r|*") as tar:
            for k, m in enumerate(tar):
                if (most is not None and k >= most) or (left is not None and left <= 0):
                    return
                if m.isreg() and not m.name.startswith(("/", "\\")) and ".." not in m.name.split("/"):
                    limits = [x for x in (peek, left) if x is not None]
                    head = _read(tar.extractfile(m), min(limits) if limits else None)
                    left = None if left is None else left - len(head)
                    yield f"{above}>{' '.join(m.name.split())[:200]}", head
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        return


def _image(data: bytes) -> tuple[bytes, list[str]] | None:
    """(configuration, names of the layers in order) of a saved image; None if the archive is none."""
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
            about = json.loads(tar.extractfile("manifest.json").read(PEEK))
            first = about[0] if about and isinstance(about[0], dict) else {}
            name = first.get("Config") or ""
            config = tar.extractfile(name).read(PEEK) if name in tar.getnames() else b""
            return config, [x for x in first.get("Layers") or [] if x and not x.startswith(("/", "\\")) and ".." not in x.split("/")]
    except (tarfile.TarError, KeyError, ValueError, AttributeError, TypeError, OSError, EOFError):
        return None


def _tars(found: DataFrame) -> DataFrame:
    return found.where(F.col("path").rlike(r"(?i)\.(tar|tgz|tar\.gz)$") | (F.decode(F.substring("content", 258, 5), "ISO-8859-1") == "ustar"))


def archive_members(found: DataFrame, *, layers: int | None = MAX_LAYERS, members: int | None = MAX_MEMBERS, peek: int | None = PEEK, budget: int | None = LAYER_BUDGET) -> DataFrame:
    """(path, member, content): regular members of tar archives, streamed, never extracted. Of a saved image, the members of its layers
    in the order of its manifest. Limits: layers of an image, members and bytes of a layer, bytes of a member; None lifts one.
    Names that leave the archive are passed over; what can be read of a broken archive counts."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                data, rows = bytes(content), []
                image = _image(data)
                if image is None:
                    rows = list(_layer(io.BytesIO(data), path, members, peek, budget))
                else:
                    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
                        names = set(tar.getnames())
                        for name in image[1][:layers]:
                            if name in names and (body := tar.extractfile(name)) is not None:
                                rows += _layer(body, f"{path}>{name}", members, peek, budget)
                if rows:
                    yield pd.DataFrame({"path": path, "member": [r[0] for r in rows], "content": [r[1] for r in rows]})

    return _tars(found).select("path", "content").mapInPandas(expand, "path string, member string, content binary")


def image_secrets(found: DataFrame) -> DataFrame:
    """Findings of variables in the configuration of saved images whose names look secret; their values never leave."""

    def configs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = [(p, _image(bytes(c))) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame([(p, i[0].decode("utf-8", "replace")) for p, i in images if i], columns=["path", "config"])

    names = secret_variables(_tars(found).select("path", "content").mapInPandas(configs, "path string, config string"))
    return names.select(F.concat("path", F.lit(">config")).alias("file_path"), F.lit(0).alias("line"), F.lit("ENV-SECRET").alias("algorithm"), F.lit("key").alias("category"), F.lit(0.6).alias("confidence"),
                        F.lit("container config reference").alias("usage"), F.concat(F.lit("ENV "), F.substring("name", 1, 64), F.lit(" present in image config (value withheld)")).alias("evidence"))
