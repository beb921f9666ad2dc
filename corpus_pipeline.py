"""The training-data pipeline: toxicity, near-duplicates, repeated substrings, mixing, packing, each over all that came through.

Counted as part of the subpackage siltstone.llm. run() writes what a stage returns as Parquet in the shared folder and reads
it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, Scratch, load
from siltstone.llm.mixing import mix
from siltstone.llm.packing import pack
from siltstone.llm.pipeline_steps import readable
from siltstone.llm.simhash import simhash_components
from siltstone.llm.suffixes import strip_repeats
from siltstone.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted toxicity go. Null and empty texts score as no evidence and stay; equal rows share their score; all stay
    if there are no labels."""
    scored = score_toxicity(docs, load(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.filter("predicted = 0").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays; rows without an id stay, and of rows that share an id all do or none.

    Candidates are fingerprints of the distinct words at most four bits apart, found at anchors; a link takes that the
    fingerprints of five-word shingles differ in ten bits at most, as they do at a similarity of 0.8 on average.
    """
    found = simhash_components(docs, words=1, distinct=True, threshold=4, reach=2, confirm=(5, 10))
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null")).select(*COLUMNS)


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that stand earlier too go; bytes of a character that is cut in two go with them; so do emptied documents. Of equal texts the first
    by id stays whole; rows of equal id stand in order of their text, null ids come first; null texts become empty ones."""
    stripped = strip_repeats(docs, carry=COLUMNS[2:4])
    texts = stripped.select("doc_id", readable("kept").alias("text"), "lang", "source", "n_removed")
    return texts.filter("n_removed = 0 or length(trim(text)) > 0").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one of no words stays away, null texts too. Rows that are equal in id, source and text
    are taken alike; null ids and sources are values like any other."""
    docs = docs.select(*COLUMNS)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    taken = mix(docs).filter("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.max("copies").alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    return docs.join(taken, same).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; rows that repeat are packed as often, empty ones are their end id."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", strip_repeated_passages),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")  # read for the last time
    return docs
