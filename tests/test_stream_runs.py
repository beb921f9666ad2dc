"""The state of a stream's scan: what waits is bounded, and what comes out is as from the sorted lines."""

import random

import pandas as pd

from siltstone.streaming import observations
from siltstone.streaming.observations import first_of_scans, sink, stored, stream_of_scans


def test_waiting_lines_are_runs():
    part = pd.DataFrame({"us": [0, 1, 2, 9_000_000, 9_000_001] * 2000, "seq": range(10_000), "lib": ["l"] * 10_000, "algo": ["a", "b"] * 5000, "op": ["use"] * 10_000})
    runs = observations._runs(part, 5)
    assert [(a, b, len(s)) for a, b, s in runs] == [(0, 2, 2), (9_000_000, 9_000_001, 2)] and runs[0][2]["l", "a", "use"] == (0, 0)
    assert len(observations._joined(runs * 3, 5, [], None)) == 2
    between = [(4_500_000, 4_500_000, {("l", "c", "use"): (4_500_000, 7)})]  # a late line fills the silence
    assert [(a, b, list(s)) for a, b, s in observations._joined(runs + between, 5, [], 2)] == [(0, 9_000_001, [("l", "a", "use"), ("l", "b", "use")])]
    assert list(observations._joined(runs, 5, [("l", "a", "use")], 2)[0][2]) == [("l", "b", "use")]


def test_many_small_batches_out_of_order(spark, tmp_path):
    rng, rows, at = random.Random(9), [], 1_700_000_000
    for k in range(400):
        at += rng.choice([0, 1, 20, 90, 400, 900 if k % 9 == 0 else 3])
        rows.append((str(rng.randrange(2)), at, k, f"APP-TELEMETRY lib=l{rng.randrange(3)} algo=a\0{rng.randrange(4)} op=use"))
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(150))
    source, schema = str(tmp_path / "in"), "scan_key string, at timestamp, seq long, value string"
    frame = lambda some: spark.createDataFrame(some, "scan_key string, s long, seq long, value string").selectExpr("scan_key", "timestamp_seconds(s) as at", "seq", "value")
    for most in (3, None):
        for k in range(0, 400, 40):
            frame(late[k : k + 40]).coalesce(1).write.mode("overwrite").parquet(f"{source}{most}/{k:03}")
        lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{source}{most}")
        sink(stream_of_scans(lines, most, 500, 300), str(tmp_path / f"out{most}"), str(tmp_path / f"cp{most}")).awaitTermination()
        until = max(r[1] for r in rows) - 300
        want = [r for r in first_of_scans(frame(rows), most, 500).collect() if r.at.timestamp() <= until]
        got = sorted(stored(spark, str(tmp_path / f"out{most}")).collect())
        assert got == sorted(want) and len(want) > 20
