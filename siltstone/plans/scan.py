"""A whole scan: files to text, certificates, lines, binaries, manifests and archives, united, deduplicated and scored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import detect, score
from siltstone.sources import files, manifests, x509
from siltstone.sources.tables import lines

#: Scanners in order; profiles: scanners, categories of code analysis (None: none, empty: all), validation. Fixed values.
SCANNERS = ["source", "binary", "container", "dependency", "hsm", "cloud"]
PROFILES = {
    "quick": (["source", "dependency", "binary"], ["dead_code", "dependencies", "structure"], False),
    "crypto": (SCANNERS, None, False),
    "codebase": (["source"], [], False),
    "full": (SCANNERS, [], False),
    "full-validation": (SCANNERS, [], True),
}
COLUMNS = ["scanner", "file_path", "line", "algorithm", "category", "key_size", "mode", "library", "curve", "usage", "confidence", "evidence", "ord"]
#: Beginning of the evidence of a certificate, fragments and names of archive members worth reading. Fixed values.
CERTIFICATE = "PEM certificate metadata"
FRAGMENTS = [".pem", ".crt", ".cer", ".key", ".p12", ".pfx", ".jks", "openssl.cnf", "ssl", "tls", "crypto", "requirements", "package.json", "package-lock.json", "pyproject.toml", "pom.xml", "cargo.toml", "go.mod"]
MEMBER_NAMES = ["requirements.txt", "package.json", "package-lock.json", "pyproject.toml", "pom.xml", "cargo.toml", "cargo.lock", "go.mod"]


def resolve_profile(name: str | None, scanners: list[str] | None = None, code: bool = False, validate: bool = False) -> dict:
    """What a profile runs; explicit settings win."""
    profile = name or "full"
    if profile not in PROFILES:
        raise ValueError(f"unknown profile '{profile}' (valid: {sorted(PROFILES)})")
    own, categories, checks = PROFILES[profile]
    picked = list(scanners or own)
    if unknown := [s for s in picked if s not in SCANNERS]:
        raise ValueError(f"unknown scanners: {unknown}")
    return {"profile": profile, "scanners": list(dict.fromkeys(picked)), "code_analysis": code or categories is not None, "code_categories": categories or None, "validate": validate or checks}


def _aligned(found: DataFrame, scanner: str, **given) -> DataFrame:
    """The columns of a finding, with those given; missing ones empty. ord: scanner, path, line, place in the line."""
    blank = {"key_size": F.lit(None).cast("int"), "confidence": F.lit(0.0), "line": F.lit(0)}
    place = F.col("emit_ord") if "emit_ord" in found.columns else F.lit(0)
    have = {c: F.col(c) for c in found.columns} | {"scanner": F.lit(scanner)} | given
    row = {c: have.get(c, blank.get(c, F.lit(""))) for c in COLUMNS if c != "ord"}
    where = F.col("place") if "place" in found.columns else row["line"]
    row["ord"] = F.struct(F.lit(SCANNERS.index(scanner)).alias("s"), row["file_path"].alias("p"), where.cast("int").alias("l"), place.cast("int").alias("e"))
    return found.select(*[F.coalesce(v, F.lit("")).alias(c) if c in ("mode", "library", "curve", "evidence") else v.alias(c) for c, v in row.items()])


def certificate_findings(texts: DataFrame, scanner: str = "source") -> DataFrame:
    """A row of line 0 for each text with a certificate that can be read."""
    found = x509.certificates(texts).withColumn("emit_ord", F.lit(-1))
    return _aligned(found, scanner, file_path=F.col("path"), line=F.lit(0), category=F.lit("certificate"), usage=F.lit("certificate metadata"), evidence=F.lit(CERTIFICATE), confidence=F.lit(0.95))


def source_findings(texts: DataFrame) -> DataFrame:
    rows = lines(texts, F.col("path"), F.col("text"))
    return certificate_findings(texts).unionByName(_aligned(detect.line_findings(rows), "source"))


#: Limits of a scan by name; None lifts one, NO_LIMITS all. Files are the first by path, of at most so many bytes; the others belong to what a
#: file holds.
LIMITS = {"max_files": files.MAX_FILES, "max_bytes": files.MAX_BYTES, "strings": files.MAX_STRINGS, "findings": 100, "layers": files.MAX_LAYERS, "members": files.MAX_MEMBERS, "peek": files.PEEK, "budget": files.LAYER_BUDGET}
NO_LIMITS = dict.fromkeys(LIMITS)


def limited(limits: dict | None) -> dict:
    """All limits, with those given in place of the usual ones."""
    if unknown := sorted(set(limits or {}) - set(LIMITS)):
        raise ValueError(f"unknown limits: {unknown}")
    return LIMITS | (limits or {})


def container_findings(found: DataFrame, members: DataFrame | None = None, limits: dict | None = None) -> DataFrame:
    """Findings of archive members: keys and certificates, configuration, manifests as text; executables as such; and of Dockerfiles."""
    most = limited(limits)
    members = files.archive_members(found, **{k: most[k] for k in ("layers", "members", "peek", "budget")}) if members is None else members
    low = F.lower("member")
    name = F.element_at(F.split(low, "[/>]"), -1)
    wanted = low.rlike("|".join(f.replace(".", r"\.") for f in FRAGMENTS)) | name.isin(MEMBER_NAMES) | name.startswith("dockerfile")
    nul = (F.instr(F.decode(F.substring("content", 1, 4096), "ISO-8859-1"), "\0") > 0) & ~F.decode("content", "ISO-8859-1").contains("-----BEGIN")
    text = members.where(wanted & ~nul).select(F.col("member").alias("path"), F.decode("content", "UTF-8").alias("text"))
    docker = found.where(F.lower(F.element_at(F.split("path", "/"), -1)).rlike("^dockerfile|dockerfile$")).select("path", F.decode("content", "UTF-8").alias("text"))
    hits = detect.line_findings(lines(text.unionByName(docker), F.col("path"), F.col("text")), "container")
    binary = detect.binary_findings(files.binary_strings(members.where(nul | ~wanted).select(F.col("member").alias("path"), "content"), most["strings"]), most["findings"])
    return reduce(DataFrame.unionByName, [certificate_findings(text, "container"), _aligned(hits, "container", usage=F.lit("container file reference")),
                                          _aligned(binary, "container", usage=F.lit("container binary reference")), _aligned(files.image_secrets(found), "container")])


def scan_files(found: DataFrame, scanners: list[str] | None = None, limits: dict | None = None) -> DataFrame:
    """(path, content, length) of files -> the findings of all scanners asked for, deduplicated, scored and named."""
    texts, most = files.texts(found), limited(limits)
    rows = lines(texts, F.col("path"), F.col("text"))
    make = {
        "source": lambda: source_findings(texts),
        "binary": lambda: _aligned(detect.binary_findings(files.binary_strings(found, most["strings"]), most["findings"]), "binary"),
        "container": lambda: container_findings(found, limits=limits),
        "dependency": lambda: _aligned(detect.package_findings(manifests.declared_packages(texts)), "dependency", library=F.substring("library", 1, 64),
                                       evidence=F.substring(F.trim(F.concat(F.substring("library", 1, 64), F.lit(" "), F.substring("version", 1, 32))), 1, 160)),
        "hsm": lambda: _aligned(detect.hsm_findings(rows), "hsm"),
        "cloud": lambda: _aligned(detect.cloud_findings(rows), "cloud"),
    }
    asked = resolve_profile(None, scanners)["scanners"]
    every = reduce(DataFrame.unionByName, [make[s]() for s in asked])
    return score.enrich(score.dedupe(every))


def scan(spark: SparkSession, root: str, profile: str | None = None, scanners: list[str] | None = None, **limits) -> DataFrame:
    """The findings of a folder. limits: any of LIMITS."""
    most = limited(limits)
    return scan_files(files.files(spark, root, max_files=most["max_files"], max_bytes=most["max_bytes"]), resolve_profile(profile, scanners)["scanners"], limits)
