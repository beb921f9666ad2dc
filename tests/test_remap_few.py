"""New names that are few are broadcast, others shuffled; a name that a row repeats is looked up once."""

from siltstone.plans import remap


def test_remap_with_few_and_with_many_names(spark):
    rows = spark.createDataFrame([(k, [f"n{k % 5}", None, f"n{k % 3}", f"n{k % 5}"], [(f"n{k % 5}", k)], f"n{k % 5}", f"n{k % 3}") for k in range(40)], "k int, ids array<string>, links array<struct<id:string,n:int>>, one string, path string")
    names = spark.createDataFrame([("id", f"n{j}", f"id{j}") for j in (0, 1, 3)] + [("path", "n2", "p2"), ("path", "n1", "p1")], "kind string, old string, new string")
    now = lambda kind, n: {"id": {0: "id0", 1: "id1", 3: "id3"}, "path": {1: "p1", 2: "p2"}}[kind].get(n, f"n{n}")
    want = [(k, [now("id", k % 5), None, now("id", k % 3), now("id", k % 5)], [(now("id", k % 5), k)], now("id", k % 5), now("path", k % 3)) for k in range(40)]
    for few, joined in ((5, True), (4, False)):
        out = remap.remapped(rows.repartition(4, "k"), "k", {"ids": "id", "links.id": "id", "one": "id", "path": "path"}, names, few)
        assert sorted((r.k, r.ids, [tuple(x) for x in r.links], r.one, r.path) for r in out.collect()) == want
        assert ("ResolvedHint (strategy=broadcast)" in out._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) is joined
