"""A corpus pipeline of five stages over ``documents``.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's documents.

Defined results: a null or empty text is never rejected for its near copies and loses no line; the two
models judge it like any other.  Rows may repeat an id: each row is judged by its own text, and exact repeats of
id and text leave the near-duplicate stage once.  An empty table gives an empty result.  Further columns,
whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deklara.llm import additive_quality, lines, minhash, packing, toxicity
from deklara.llm.common import materialise, remove, row_of, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return additive_quality.accepted(docs, additive_quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines one occurrence stays; all documents stay, with what is left of their text."""
    return lines.deduplicated(docs, counts=False)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, with or without an id; rows that repeat its id and text are
    the same document.  Those with an empty set all stay, but for such repeats of one id."""
    found, path = materialise(minhash.near_duplicates(docs, marks=True).where("kept").select("doc_id", "mark", "group"), "kept")
    counted = found.groupBy("group", "doc_id", "mark").agg(F.count("*").alias("n"))
    grouped = counted.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "mark", "n")).alias("first")).select("first.*")
    blank = counted.where("group is null and doc_id is not null").select("doc_id", "mark", "n")
    staying = grouped.unionByName(blank).select(F.col("doc_id").alias("at"), F.col("mark").alias("marked"), "n")
    staying, _ = materialise(staying, "staying")
    remove(spark, path)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("mark"), row_of(docs))
    kept = keyed.join(staying, keyed["id"].eqNullSafe(staying["at"]) & (keyed["mark"] == staying["marked"]))
    once = kept.where("n = 1").select("row")
    repeated = kept.where("n > 1").dropDuplicates(["id", "mark"]).select("row")
    blank = docs.where("doc_id is null").where(F.coalesce(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))).select(row_of(docs))
    return once.unionByName(repeated).unionByName(blank).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The stages hold trained models and sketches, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
