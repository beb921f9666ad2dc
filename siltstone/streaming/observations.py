"""Runtime observations of scans as they happen: one keyed state for a scan, alike on a stream and on a table.

A scan is a run of telemetry lines of one key in event time; silence of more than `idle` ends it. Of a scan the first `most` different
observations (library, algorithm, operation) count, each where it is first seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from siltstone.streaming.telemetry import MOST, category, parse

#: How late a line may come, and the silence that ends a scan, in seconds.
DELAY, IDLE = 600, 3600
#: (scan, begin, place, at, seq, lib, algo, op): place counts from 1 in a scan.
OBSERVED = "scan_key string, begin timestamp, place int, at timestamp, seq long, lib string, algo string, op string"
_STATE = "begun boolean, start array<long>, stop array<long>, run array<int>, at array<long>, seq array<long>, lib array<string>, algo array<string>, op array<string>"
#: A run of lines without a silence: time of its first and last line, and the first line (at, seq) of each different observation.
Run = tuple[int, int, dict[tuple, tuple]]


def observed(lines: DataFrame) -> DataFrame:
    """(scan_key, at, seq, value) -> lib, algo, op instead of value, of the lines that are telemetry."""
    return parse(lines).select("scan_key", F.col("at").cast("timestamp").alias("at"), "seq", "lib", "algo", "op")


def first_of_scans(lines: DataFrame, most: int | None = MOST, idle: int = IDLE) -> DataFrame:
    """The observations of a table. Windows: beginnings of scans by gaps, the first of equal ones, their places."""
    turn = Window.partitionBy("scan_key").orderBy("at", "seq")
    rows = observed(lines)
    gap = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(turn) > idle * 1_000_000
    rows = rows.withColumn("_run", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(turn)).withColumn("begin", F.min("at").over(Window.partitionBy("scan_key", "_run")))
    same = Window.partitionBy("scan_key", "_run", "lib", "algo", "op").orderBy("at", "seq")
    rows = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("scan_key", "_run").orderBy("at", "seq")))
    rows = rows if most is None else rows.where(F.col("place") <= most)
    return rows.select("scan_key", "begin", "place", "at", "seq", "lib", "algo", "op")


def _runs(part: pd.DataFrame, idle: int) -> list[Run]:
    """The runs of some lines of a scan's key."""
    out: list[Run] = []
    start = stop = None
    for at, seq, *what in sorted(zip(*[part[c] for c in ("us", "seq", "lib", "algo", "op")], strict=True)):
        if stop is None or at - stop > idle * 1_000_000:
            start, seen = int(at), {}
            out.append((start, start, seen))
        stop = int(at)
        out[-1] = (start, stop, seen)
        seen.setdefault(tuple(what), (stop, int(seq)))
    return out


def _joined(runs: list[Run], idle: int, known: list[tuple], most: int | None) -> list[Run]:
    """Runs with less than a silence between them are one. Of a run the first `most` observations stay; the earliest run has said those known already."""
    out: list[Run] = []
    for start, stop, seen in sorted(runs, key=lambda r: r[:2]):
        if out and start - out[-1][1] <= idle * 1_000_000:
            begin, end, have = out.pop()
            for what, turn in seen.items():
                have[what] = min(turn, have.get(what, turn))
            start, stop, seen = begin, max(end, stop), have
        out.append((start, stop, seen))
    if out and known:
        out[0] = (*out[0][:2], {w: t for w, t in out[0][2].items() if w not in known})
    for k, (start, stop, seen) in enumerate(out):
        n = None if most is None else most - len(known) * (k == 0)
        out[k] = (start, stop, dict(sorted(seen.items(), key=lambda x: x[1])[:n]))
    return out


def stream_of_scans(lines: DataFrame, most: int | None = MOST, idle: int = IDLE, delay: int = DELAY) -> DataFrame:
    """The observations of a stream, as first_of_scans gives them for lines that come at most `delay` late.

    What is written does not depend on the order of arrival, the micro-batches, or restarts: an observation waits in the state of its scan until the
    watermark passes it. Lines do not wait: lines that come later can fill a silence but never make one, so of lines without a silence between them
    only the ends and the first line of each different observation can still count, of which at most the first `most`. A state has these for each
    run of lines that the watermark has not passed, however many lines a micro-batch has; it goes when the scan has been silent for `idle` seconds.
    idle must not be less than delay.
    """
    if idle < delay:
        raise ValueError("idle must not be less than delay")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, starts, stops, *held = state.get if state.exists else (False, [], [], [], [], [], [], [], [])
        known: list[tuple] = []  # run -1
        runs: list[Run] = [(a, b, {}) for a, b in zip(starts or [], stops or [], strict=True)]
        for k, at, seq, *what in zip(*[x or [] for x in held], strict=True):
            if k < 0:
                known.append(tuple(what))
            else:
                runs[k][2][tuple(what)] = (at, seq)
        if not state.hasTimedOut:
            for p in parts:
                if len(p):
                    runs = _joined(runs + _runs(p, idle), idle, known, most)
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        for k, (start, _, seen) in enumerate(runs):
            if start > passed:
                break
            if k or not begun:  # the run before is over
                begun, known = True, []
            for what, turn in [x for x in seen.items() if x[1][0] <= passed]:
                del seen[what]
                known.append(what)
                out.append((key[0], start, len(known), *turn, *what))
        if begun:
            runs = runs[max(k for k, r in enumerate(runs) if k == 0 or r[0] <= passed) :]
            if not runs[0][2] and (runs[0][1] + idle * 1_000_000) // 1000 + 1 <= state.getCurrentWatermarkMs():
                begun, known, runs = False, [], runs[1:]
        if not runs:
            state.remove()
        else:
            waiting = [(k, *turn, *what) for k, (_, _, seen) in enumerate(runs) for what, turn in seen.items()]
            wake = min((w[1] // 1000 for w in waiting), default=(runs[0][1] + idle * 1_000_000) // 1000 + 1)
            said = [(-1, 0, 0, *w) for w in known]
            state.update((begun, [r[0] for r in runs], [r[1] for r in runs], *[[w[j] for w in said + waiting] for j in range(6)]))
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        names = ["scan_key", "begin", "place", "at", "seq", "lib", "algo", "op"]
        found = pd.DataFrame(out, columns=names).astype({"begin": "int64", "at": "int64", "place": "int32", "seq": "int64"})
        yield found

    rows = observed(lines).withWatermark("at", f"{delay} seconds").withColumn("us", F.unix_micros("at"))  # whatever the session's zone is
    found = rows.groupBy("scan_key").applyInPandasWithState(step, OBSERVED.replace("timestamp", "long"), _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({"begin": F.timestamp_micros("begin"), "at": F.timestamp_micros("at")})


def with_category(found: DataFrame) -> DataFrame:
    return found.withColumn("category", category(F.col("algo"), F.col("op")))


def sink(found: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends to a folder of Parquet. What counts is in the sink's own log, which names the files of each micro-batch once; after a stop or a failure
    the stream goes on from its checkpoint and writes nothing twice."""
    return found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """What a sink has written."""
    return spark.read.schema(OBSERVED).parquet(folder)
