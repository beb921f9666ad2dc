"""Dependency manifests to declared packages. JSON, TOML and XML need a parser, so a file is read as a whole in an Arrow batch."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import rules

#: Forms of lines and entries, sections, how deep includes are followed, and files that are Python objects at once. Fixed values.
REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*([^;#\s]*)\s*(?:[#;].*)?$")
INCLUDE = re.compile(r"^\s*-[rc]\s+(\S+)")
GRADLE = re.compile(r"""['"]([^'":\s]+):([^'":\s]+):([^'":\s]+)['"]""")
GO_MODULE = re.compile(r"^\s*(?:require\s+)?([\w.\-/]+(?:/[\w.\-]+)+)\s+(v[\w.+-]+)")
TOKEN, VERSION = re.compile(r"[A-Za-z0-9_.\-/~^<>=! ]{3,80}"), re.compile(r"version\s*[:=]\s*[\"']([^\"']+)[\"']", re.I)
JSON_SECTIONS, LOCK_SECTIONS, DEPTH = ("dependencies", "devDependencies", "peerDependencies"), ("packages", "dependencies"), 3
HELD_FILES = 512

Pairs = Iterator[tuple[str, str]]


def _mapping(value) -> dict:
    return value if isinstance(value, dict) else {}


def of_requirements(text: str) -> Pairs:
    for line in text.splitlines():
        if line.strip() and not line.strip().startswith(("#", "-", "!")) and (m := REQUIREMENT.match(line.strip())):
            yield m[1], m[2]


def of_package_json(text: str) -> Pairs:
    data = _mapping(json.loads(text))
    for section in JSON_SECTIONS:
        yield from ((name, str(version)) for name, version in _mapping(data.get(section)).items())


def of_package_lock(text: str) -> Pairs:
    data = _mapping(json.loads(text))
    for section in LOCK_SECTIONS:
        for key, about in _mapping(data.get(section)).items():
            name, version = key.rpartition("node_modules/")[2], _mapping(about).get("version")
            if name and version:
                yield name, str(version)


def of_toml(text: str) -> Pairs:
    data = tomllib.loads(text)
    for entry in _mapping(data.get("project")).get("dependencies") or []:
        if m := REQUIREMENT.match(str(entry)):
            yield m[1], m[2]
    poetry = _mapping(_mapping(data.get("tool")).get("poetry")).get("dependencies")
    yield from ((name, v if isinstance(v, str) else "") for name, v in _mapping(poetry).items() if name != "python")
    yield from ((name, str(v.get("version", "")) if isinstance(v, dict) else str(v)) for name, v in _mapping(data.get("dependencies")).items())


def of_cargo_lock(text: str) -> Pairs:
    yield from ((str(p.get("name", "")), str(p.get("version", ""))) for p in tomllib.loads(text).get("package", []))


def of_pom(text: str) -> Pairs:
    for dependency in ET.fromstring(text).iter():
        if dependency.tag.rpartition("}")[2] == "dependency":
            held = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in reversed(dependency)}  # the first of a name counts
            if held.get("artifactId"):
                yield held["artifactId"], held.get("version", "")


def of_gradle(text: str) -> Pairs:
    yield from ((m[2], m[3]) for m in GRADLE.finditer(text))


def of_go(text: str) -> Pairs:
    yield from ((m[1], m[2]) for line in text.splitlines() if "=>" not in line and (m := GO_MODULE.match(line)))


def of_any(text: str) -> Pairs:
    """Known packages among the tokens of a text, the first of each line, with the version that the line names."""
    done = -1
    for m in TOKEN.finditer(text):
        name, begin = m[0].strip(" \"',"), text.rfind("\n", 0, m.start()) + 1
        if begin > done and re.sub(r"[-_.]+", "-", name.lower()) in rules.PACKAGES:
            done, end = begin, text.find("\n", m.end())
            version = VERSION.search(text, begin, end if end >= 0 else len(text))
            yield name, version[1] if version else ""


READERS = {"package.json": of_package_json, "package-lock.json": of_package_lock, "pyproject.toml": of_toml, "cargo.toml": of_toml, "cargo.lock": of_cargo_lock, "pom.xml": of_pom,
           "build.gradle": of_gradle, "build.gradle.kts": of_gradle, "go.mod": of_go}


def pairs(name: str, text: str) -> list[tuple[str, str]]:
    """(package, version) in a manifest of a lower-cased name; none if it can't be read."""
    reader = of_requirements if name.startswith("requirements") else READERS.get(name, of_any)
    try:
        return list(reader(text))
    except (ValueError, RecursionError, ET.ParseError, AttributeError, TypeError):
        return []


def is_manifest(path: F.Column) -> F.Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return name.isin(rules.PACKAGE_MANIFESTS) | name.startswith("requirements")


def _read(texts: DataFrame, as_requirements: bool) -> DataFrame:
    """(path, kind, name, version): the packages of texts, and what requirements among them include (all of them, if as_requirements)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, HELD_FILES) for whole in batches for at in range(0, whole.num_rows, HELD_FILES)):
            rows = []
            for p, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = "requirements" if as_requirements else p.rpartition("/")[2].lower()
                rows += [(p, "package", *x) for x in pairs(name, t or "")]
                if name.startswith("requirements"):
                    rows += [(p, "include", m[1], "") for line in (t or "").splitlines() if (m := INCLUDE.match(line))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "kind", "name", "version"])

    return texts.select("path", "text").mapInArrow(read, "path string, kind string, name string, version string")


def _includes(found: DataFrame) -> DataFrame:
    """(above, child) of included files in the folder of the file that names them, or below it."""
    folder, target = F.regexp_replace("path", "[^/]*$", ""), F.regexp_replace("name", r"^(\./)+", "")
    return found.where("kind = 'include'").where(~target.rlike(r"(^|/)\.\.(/|$)") & ~target.startswith("/")).select(F.col("path").alias("above"), F.concat(folder, target).alias("child")).distinct()


def declared_packages(texts: DataFrame) -> DataFrame:
    """(path, text) -> (path, name, version) of the manifests among the texts. A requirements file has the packages of those that it
    includes from its own folder or below too, three deep; each level is an equi-join on the path."""
    found = _read(texts.where(is_manifest(F.col("path"))), False)
    level = _includes(found)
    packages, reach = found.where("kind = 'package'").select("path", "name", "version"), level
    for _ in range(DEPTH):
        below = _read(texts.join(level.select(F.col("child").alias("path")).distinct(), "path", "left_semi"), True)
        held = below.where("kind = 'package'").select(F.col("path").alias("child"), "name", "version")
        packages = packages.union(level.join(held, "child").select(F.col("above").alias("path"), "name", "version"))
        deeper = _includes(below).select(F.col("above").alias("child"), F.col("child").alias("next"))
        level = level.join(deeper, "child").select("above", F.col("next").alias("child")).where("above <> child").distinct().join(reach, ["above", "child"], "left_anti")
        reach = reach.union(level)
    return packages.distinct()
