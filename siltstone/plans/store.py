"""Stores of scans and of triage: immutable Parquet folders, and a log of snapshots that say which of them count.

A writer puts its rows into a folder of its own, then commits a snapshot: the next file of the log, created only if it does not exist. Who comes
second reads the log anew and tries again, so no commit is lost and readers see whole ones; a writer that dies leaves a folder that no
snapshot names, for `vacuum`. A snapshot holds one entry a scan, or a bucket of triage.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import relate
from siltstone.plans.report import KEPT_SCANS, SCAN_ID
from siltstone.sources.shared import Folder

#: Log files that stay behind the newest, tries of a commit, age from which a folder that no snapshot names is left over.
KEPT_VERSIONS, TRIES, LEFT_OVER_MS = 10, 100, 24 * 3600 * 1000
#: Buckets that triage is spread over.
BUCKETS = 32


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("log") if n.endswith(".json") and n[:-5].isdigit()]

    def latest(self) -> tuple[int, dict]:
        """(version, entries) of the newest snapshot; 0 and none before the first."""
        found = self.versions()
        return (found[-1], json.loads(self.folder.read(f"log/{found[-1]:020d}.json"))) if found else (0, {})

    def update(self, change: Callable[[dict], dict]) -> tuple[dict, dict]:
        """Commits change(entries); (entries before, after). It is called again on newer entries if another commit came between."""
        for _ in range(TRIES):
            version, before = self.latest()
            after = change(dict(before))
            if self.folder.create(f"log/{version + 1:020d}.json", json.dumps(after, sort_keys=True)):
                for old in self.versions()[: -KEPT_VERSIONS - 1]:
                    self.folder.delete(f"log/{old:020d}.json")
                return before, after
        raise RuntimeError(f"{TRIES} commits came between")

    def folders(self, entries: dict) -> list[str]:
        return sorted(f"{self.path}/{e['folder']}" for e in entries.values())

    def drop(self, before: dict, after: dict) -> None:
        """Deletes folders that entries named before and none names now."""
        kept = {e["folder"] for e in after.values()}
        for e in before.values():
            if e["folder"] not in kept:
                self.folder.delete(e["folder"])

    def vacuum(self, least_age_ms: int = LEFT_OVER_MS) -> list[str]:
        """Deletes folders of writers that never committed, if they are old enough; their names."""
        kept = {e["folder"].split("/")[1] for e in self.latest()[1].values()}
        left = [n for n in self.folder.names("data") if n not in kept and self.folder.age_ms(f"data/{n}") >= least_age_ms]
        for n in left:
            self.folder.delete(f"data/{n}")
        return left


class ScanStore(Snapshots):
    """The newest scans, a Parquet folder each; older ones are deleted as newer ones come."""

    def __init__(self, spark: SparkSession, path: str, keep: int | None = KEPT_SCANS):
        super().__init__(spark, path)
        self.keep = keep

    def _newest(self, entries: dict) -> dict:
        order = sorted(entries, key=lambda k: (-entries[k]["scan_time"], k))
        return {k: entries[k] for k in (order if self.keep is None else order[: self.keep])}

    def save(self, findings: DataFrame) -> dict:
        """Adds the scans of (scan_id, scan_time, severity, ...), in one commit; a scan of a name that is there replaces it, so a retry
        repeats nothing. Only scans that stay are written. Returns the entries.

        The driver holds one entry for each scan that stays.
        """
        bad = findings.where(~F.coalesce(F.col("scan_id"), F.lit("")).rlike(SCAN_ID)).limit(1).count()
        if bad:
            raise ValueError("invalid scan id")
        counts = [F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high")]]
        index = findings.groupBy("scan_id").agg(F.max(F.col("scan_time").cast("double")).alias("scan_time"), *counts).orderBy(F.desc("scan_time"), "scan_id")
        name = f"data/{uuid.uuid4().hex}"
        rows = (index if self.keep is None else index.limit(self.keep)).collect()
        new = {r.scan_id: {"folder": f"{name}/scan_id={r.scan_id}", "scan_time": r.scan_time or 0.0, "findings": r.findings, "critical": r.critical, "high": r.high} for r in rows}
        staying = [k for k in self._newest(self.latest()[1] | new) if k in new]
        if not staying:
            return self.latest()[1]
        ids = self.spark.createDataFrame([(k,) for k in staying], "scan_id string")
        findings.join(ids, "scan_id", "left_semi").write.partitionBy("scan_id").parquet(f"{self.path}/{name}")
        written = {k: new[k] for k in staying}
        before, after = self.update(lambda entries: self._newest(entries | written))
        self.drop(before, after)
        self.drop(written, after)  # what another commit has made too old meanwhile
        return after

    def delete(self, scan_id: str) -> bool:
        before, after = self.update(lambda entries: {k: e for k, e in entries.items() if k != scan_id})
        self.drop(before, after)
        return scan_id in before

    def history(self) -> DataFrame:
        """(scan_id, scan_time, findings, critical, high), newest first; from the log alone."""
        rows = [(k, float(e["scan_time"]), e["findings"], e["critical"], e["high"]) for k, e in self._newest(self.latest()[1]).items()]
        return self.spark.createDataFrame(rows, "scan_id string, scan_time double, findings long, critical long, high long")

    def read(self, *scan_ids: str) -> DataFrame | None:
        """The findings of the scans named, or of all; None if there are none. Only their folders are read."""
        entries = self.latest()[1]
        paths = self.folders({k: entries[k] for k in scan_ids or entries if k in entries})
        if not paths:
            return None
        return self.spark.read.option("recursiveFileLookup", True).parquet(*paths).withColumn("scan_id", F.regexp_extract(F.col("_metadata.file_path"), "scan_id=([^/]+)/", 1))

    def previous(self, scan_id: str) -> str | None:
        """The scan before one."""
        order = list(self._newest(self.latest()[1]))
        return order[order.index(scan_id) + 1] if scan_id in order[:-1] else None


class TriageStore(Snapshots):
    """(scope, fingerprint, status, reason, seq): the last writer by seq counts. Rows lie in buckets by hash of the key; a save writes the
    buckets anew that it touches, and no others."""

    KEY = ["scope", "fingerprint"]

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark, path)
        self.buckets = buckets

    def _last(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in [*self.KEY, "seq"]]
        last = F.max(F.struct("seq", *sorted(rest))).alias("last")  # equal seq: the greatest of the rest, whoever comes first
        return rows.groupBy(*self.KEY).agg(last).select(*self.KEY, *[F.col(f"last.{c}").alias(c) for c in rows.columns if c not in self.KEY])

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.KEY), F.lit(self.buckets)).cast("int")

    def save(self, changes: DataFrame) -> None:
        """Upserts changes (scope, fingerprint, status, reason, seq) in one commit. States get their names of today, a reason stays with a
        suppression only; rows without scope or seq are no entries. One that can't be recorded (`relate.triage_fault`) fails the save."""
        rows = changes.where("scope is not null and seq is not null").withColumn("status", relate.migrated_triage(F.col("status")))
        fault = relate.triage_fault(F.col("status"), F.col("fingerprint"), F.col("reason"))
        if (bad := rows.select(fault.alias("fault")).where("fault is not null").first()) is not None:
            raise ValueError(bad.fault)
        rows = rows.withColumn("reason", F.when(F.col("status") == "suppressed", F.col("reason")).otherwise(""))
        rows = self._last(rows)
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most `buckets`
        base: dict = {}
        merged: dict = {}

        def change(entries: dict) -> dict:
            mine = {str(b): entries.get(str(b)) for b in touched}
            if not merged or mine != base:  # else another commit touched other buckets only
                base.clear(), merged.clear()
                base.update(mine)
                held = self.folders({b: e for b, e in mine.items() if e})
                both = rows.unionByName(self.spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(*held)) if held else rows
                name = f"data/{uuid.uuid4().hex}"
                self._last(both).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
                merged.update({str(b): {"folder": f"{name}/bucket={b}"} for b in touched})
            return entries | merged

        if touched:
            before, after = self.update(change)
            self.drop(before, after)

    def load(self) -> DataFrame | None:
        paths = self.folders(self.latest()[1])
        return self.spark.read.option("recursiveFileLookup", True).parquet(*paths) if paths else None
