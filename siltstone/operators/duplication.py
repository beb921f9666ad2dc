"""Duplicate windows of lines, and a greedy cover of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

if TYPE_CHECKING:  # workers that parse need no pandas
    import pandas as pd

#: Widths of windows, least lines of content, most findings. Fixed values.
WIDTHS, LEAST_LINES, MOST = (12, 8, 6), 6, 100


def normalised(line: Column, near: bool) -> Column:
    """A line without white space around it; null if nothing is left or it is a comment. For near duplicates numbers and strings are masked."""
    text = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    kept = F.when((text != "") & ~text.startswith("#") & ~text.startswith("//"), text)
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)\b0x[0-9a-fA-F]+\b|\b\d+(\.\d+)?\b", "<NUM>"), "'[^']*'|\"[^\"]*\"", "<STR>") if near else kept


def windows(texts: DataFrame, near: bool = False, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(path, start, width, key) of windows of lines with enough content; the key is a digest.

    A line is normalised once. A row is exploded to its windows of all widths, each with its own lines only, so that what is
    written grows with the text and not with its square.
    """
    lined = texts.select("path", F.transform(F.split("text", "\n"), lambda x: normalised(x, near)).alias("lines"))
    cut = lambda w: F.when(F.size("lines") >= w, F.transform(F.sequence(F.lit(1), F.size("lines") - w + 1), lambda i: F.struct(
        i.alias("start"), F.lit(w).alias("width"), F.array_compact(F.slice("lines", i, w)).alias("kept"))))
    rows = lined.select("path", F.explode(F.concat(*[F.coalesce(cut(w), F.array()) for w in widths])).alias("w")).select("path", "w.*").where(F.size("kept") >= LEAST_LINES)
    return rows.select("path", "start", "width", F.concat(F.lit("near" if near else "exact"), F.substring(F.sha1(F.array_join("kept", "\n")), 1, 16)).alias("key"))


def repeated(found: DataFrame) -> DataFrame:
    """(key, occurrences, files, path, start, width) of windows seen twice or more; place is that of the first by path and width."""
    first = F.min(F.struct("path", (-F.col("width")).alias("w"), "start")).alias("f")
    groups = found.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("path").alias("files"), first).where("occurrences >= 2")
    return groups.select("key", "occurrences", "files", "f.path", "f.start", (-F.col("f.w")).alias("width")).where("files > 1 or (width >= 12 and key like 'exact%')")


def cover(candidates: DataFrame, most: int | None = MOST) -> DataFrame:
    """Widest first, then by key, those whose start no accepted one of the same file covers; None lifts the limit.

    Whether a window is accepted hangs only on windows that begin at most the greatest width before it. A file's candidates are thus cut where as
    many lines have none. A task passes over its runs in order, so a run costs no frame of its own. In a run the lines that accepted windows cover are
    marks by place, so a candidate asks for one mark, however many were accepted.
    """
    at = Window.partitionBy("path").orderBy("start")
    apart = F.col("start") - F.lag("start").over(at) > max(WIDTHS)
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # that many tasks, however small the rows are
    runs = candidates.repartition(n, "path").withColumn("_run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(at))

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, marks = None, set()
        for b in batches:  # a run may go on in the next batch
            keep = []
            for path, no, start, width in zip(b["path"], b["_run"], b["start"].tolist(), b["width"].tolist(), strict=True):
                if (path, no) != run:
                    run, marks = (path, no), set()
                keep.append(start not in marks)
                if keep[-1]:
                    marks.update(range(start, start + width + 1))
            yield b[keep].drop(columns="_run")

    kept = runs.sortWithinPartitions("path", "_run", F.desc("width"), "key").mapInPandas(accept, candidates.schema)
    return kept if most is None else kept.orderBy(F.desc("width"), "key").limit(most)


def findings(texts: DataFrame, most: int | None = MOST) -> DataFrame:
    """(path, line, name, category, title, confidence, impact, effort, risk): a finding for each window of the cover, exact and near together."""
    found = windows(texts).unionByName(windows(texts, True))
    kept = cover(repeated(found), most)
    cross, near = F.col("files") > 1, F.col("key").startswith("near")
    title = F.concat(F.when(near, "Near-duplicate").otherwise("Duplicate"), F.lit(" block ("), F.col("occurrences").cast("string"), F.lit("×, ~"), F.col("width").cast("string"), F.lit(" lines)"))
    return kept.select("path", F.col("start").alias("line"), F.lit("").alias("name"), F.lit("DUPLICATION").alias("category"), title.alias("title"), F.when(cross & ~near, "MEDIUM").otherwise("LOW").alias("confidence"),
                       F.when(cross, "MEDIUM").otherwise("LOW").alias("impact"), F.lit("MEDIUM").alias("effort"), F.lit("MEDIUM").alias("risk"))
