"""Facts leave a worker, and files enter it, in small pieces without pandas."""

from pyspark.sql import functions as F

from siltstone.operators import code


def test_facts_of_many_files_and_of_half_a_surrogate_pair(spark):
    n = code.HELD_FILES * 2 + 3
    texts = spark.range(n).coalesce(1).select(F.format_string("f%04d.py", "id").alias("path"), F.when(F.col("id") == 5, "a = '\\ud800b'").when(F.col("id") == 6, "a = (").otherwise("b = 1").alias("text"))
    got = code.python_facts(texts)
    assert got.schema.simpleString() == "struct<path:string,kind:string,name:string,line:int,scope:string,detail:string,n:int>"
    by_path = {(r.path, r.kind, r.name, r.line) for r in got.collect()}
    assert by_path == {(f"f{k:04d}.py", "use", "b", 1) for k in range(n) if k not in (5, 6)} | {("f0005.py", "use", "a", 1), ("f0005.py", "string", "?b", 1), ("f0006.py", "broken", "", 0)}
