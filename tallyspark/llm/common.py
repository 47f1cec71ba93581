"""What the text operators share: reading, row keys, stage tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import shared_dir

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Set, shuffle files go as soon as the query that wrote them has ended, not when the driver's memory is next collected.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage so that lost executors cost no recomputation, and
    frees what its shuffles hold on disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def with_key(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Only (doc_id, text, tkey): tkey tells rows apart that share a doc_id but not a text; null ids stay."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("tkey", F.xxhash64("text"))


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """(row, doc_id, tkey): all columns of docs in the struct `row`, so that no name of theirs meets an operator's; columns
    named like one of `own`, which the operator adds, are left out."""
    names = [c for c in docs.columns if c not in own]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"))


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), longs, by alternating large and small stars.

    Returns (node, component) for every node that is not itself the smallest of its component. Each round is a few
    keyed joins and is written to the shared folder; only a count and a checksum reach the driver. Rounds go on until
    one changes nothing, of which there are about as many as the square of the logarithm of the longest path.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, seen = stage(pairs, "edges"), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = stage(small.where("u <> v").distinct(), "edges")
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
