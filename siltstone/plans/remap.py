"""New names of findings and paths inside nested arrays, keeping every place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import kept

#: Values of a row before, in array columns: dotted for a field of an array of structs; and what kind of name each holds.
Columns = dict[str, str]


def _values(df: DataFrame, column: str) -> Column:
    """The names in a column, as an array."""
    outer, _, field = column.partition(".")
    if df.schema[outer].dataType.typeName() != "array":
        return F.array(F.col(outer))
    return F.transform(outer, lambda x: x[field]) if field else F.col(outer)


#: Names that every executor may hold; with more, places and names are shuffled to each other.
FEW = 1 << 18


def remapped(rows: DataFrame, key: str, columns: Columns, names: DataFrame, few: int = FEW) -> DataFrame:
    """Rows with new names, by (kind, old, new), in place of the old ones in all columns; names without a new one stay, and so do
    order, repeats, nulls and empty arrays. key must tell rows apart.

    Each different name of a row, in whatever columns and places, becomes one short row (key, kind, name), and these meet the new names in one
    equi-join; what changes goes back as one map a row, which a projection applies to all places. New names are counted before: at most `few`
    are broadcast, so rows that lie by their key are not moved; more are shuffled, and a name that a third of all links hold is then one row of
    `names` and many short rows on the other side, which adaptive execution splits. rows are read twice.
    """
    new = kept(names.where("old is not null and old <> new").groupBy("kind", "old").agg(F.min("new").alias("new")), "names")
    new = F.broadcast(new) if new.limit(few + 1).count() <= few else new

    def said(column: str, kind: str) -> Column:
        found = F.transform(_values(rows, column), lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("old")))
        return F.coalesce(F.filter(found, lambda x: x["old"].isNotNull()), F.array().cast("array<struct<kind:string,old:string>>"))

    every = F.array_distinct(F.concat(*[said(c, kind) for c, kind in columns.items()]))
    long = rows.select(F.col(key).alias("_key"), F.explode(every).alias("v")).select("_key", "v.*")
    changed = long.join(new, ["kind", "old"]).select("_key", F.concat("kind", F.lit(":"), "old").alias("was"), "new")
    changes = changed.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("was", "new"))).alias("_changes"))
    out = rows.join(changes, F.col(key) == F.col("_key"), "left")

    def named(c: str, kind: str) -> Column:
        outer, _, field = c.partition(".")
        now = lambda x: F.coalesce(F.try_element_at(F.col("_changes"), F.concat(F.lit(f"{kind}:"), x.cast("string"))), x)
        if rows.schema[outer].dataType.typeName() != "array":
            return now(F.col(outer))
        return F.transform(outer, lambda x: x.withField(field, now(x[field])) if field else now(x))

    for c, kind in columns.items():
        outer = c.partition(".")[0]
        out = out.withColumn(outer, F.when(F.col("_changes").isNull(), F.col(outer)).otherwise(named(c, kind)))
    return out.select(*rows.columns)


def names_of(relativized: DataFrame) -> DataFrame:
    """(kind, old, new) of ids and paths of findings that report.relativized has moved, read once."""
    moved = [F.struct(F.lit(k).alias("kind"), F.col(old).alias("old"), F.col(new).alias("new")) for k, old, new in (("id", "old_id", "id"), ("path", "old_path", "file_path"))]
    return relativized.select(F.inline(F.array(*moved))).where("old <> '' and old <> new").distinct()


def below_prefix(column: Column, prefix: str) -> Column:
    """Paths of an array that are relative and not yet below the prefix, put below it."""
    return F.transform(column, lambda v: F.when((v != "") & ~v.startswith("/") & ~v.startswith(prefix + "/"), F.concat(F.lit(prefix + "/"), v)).otherwise(v))
