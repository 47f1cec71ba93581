"""The corpus pipeline: toxic documents go, then shared lines, near duplicates and repeated passages; the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again. All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import lines, packing, simhash, substrings, toxicity
from tallyspark.llm.common import shared_dir, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame, changed=None) -> DataFrame:
    """The columns of documents; n_chars is counted anew where the text changed."""
    if changed is not None:
        docs = docs.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more go. The lexicon is learned from the labelled rows.

    A null or empty text scores 0 and stays; equal rows score alike and stay or go together; other nulls change nothing.
    """
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(toxicity.with_score(docs, lexicon).where("_score < 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line that 10 documents or more share only the first occurrence stays; a document that was nothing else stays, empty."""
    kept = lines.apply_bitmaps(docs.select(*COLUMNS), lines.line_bitmaps(docs, keep_first=True))
    return _columns(kept, F.col("_n_dropped") > 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest doc_id stays; rows without a doc_id stay."""
    found = simhash.similar_components(docs)
    return _columns(simhash.keep_first(docs, found))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that a smaller doc_id has too go.

    A null or empty text stays as it is, and so does a row without a doc_id, which no other is smaller than; rows of one
    doc_id keep the same words. A document of which nothing is left stays, empty.
    """
    kept = substrings.remove_repeats(docs.select(*COLUMNS))
    return _columns(kept, F.col("_n_removed") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 2048 ids.

    A null or empty text is one piece that holds the end id alone; rows without a doc_id and repeated rows are packed one
    by one; an empty table gives no row.
    """
    return packing.pack(stage(packing.pieces(docs).drop("ids"), "pieces"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_passages), ("packing", pack)]
#: Learned lexicons, fingerprints, anchors and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES:
        step(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    return docs
