"""Components end when nothing changes, whatever the hashes say; licence statements of any length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.llm import components, licenses
from siltstone.llm.common import Scratch


def united(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize("clash", [False, True])
def test_components_of_long_paths(spark, monkeypatch, clash):
    if clash:  # every table has the same fingerprint
        monkeypatch.setattr(components, "fingerprint", lambda edges: (edges.count() * 0,))
    rng = random.Random(6)
    path = list(range(0, 120))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (500, 501), (500, 501)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df, Scratch(spark, "cc")).collect()}
    assert got == united(edges)


def test_components_of_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0


def test_long_statements_without_an_end(spark):
    """Two hundred thousand words on a line, most of them different, around a statement."""
    words = " ".join(f"w{k}" for k in range(100_000))
    text = f"{words} licensed under the apache license version 2.0 {words}"
    rows = spark.createDataFrame([(1, text), (2, "Released under the MIT License"), (3, words)], "doc_id long, text string")
    licenses.scan_licenses(rows.where("doc_id > 1"), path=F.lit("a/b")).collect()
    began = time.time()
    got = {r.doc_id: r.own_license for r in licenses.scan_licenses(rows, path=F.lit("a/b")).collect()}
    assert got == {1: "Apache-2.0", 2: "MIT", 3: None} and time.time() - began < 60
