"""Several outputs of one table, in one pass and one commit.

Spark's own writer puts each output's rows in a folder of a fresh place; a manifest then names all of them at once. Until it
does readers see the outputs before, so a failing task or a lost driver publishes nothing, and what was written is named nowhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from .versioned import Table

OUTPUT = "_output"


def _manifests(spark: SparkSession, path: str) -> Table:
    return Table(spark, path, "", OUTPUT)


def publish(rows: DataFrame, path: str, outputs: dict[str, Column]) -> dict[str, int]:
    """Write each row to all outputs whose condition it meets (null: it doesn't) and publish them together as CSV.

    Returns the rows of each output, empty ones too. A row that meets no condition is an error, and so is another writer's
    publication since this one began; both publish nothing. Conditions need not exclude each other.
    """
    if OUTPUT in rows.columns:
        raise ValueError(f"a column may not be called {OUTPUT}")
    spark, seen, given = rows.sparkSession, Observation(), Observation()
    table = _manifests(spark, path)
    base, folder = table.version(), f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"
    names = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in outputs.items())))
    sent = rows.withColumn(OUTPUT, names).observe(given, F.count_if(F.size(OUTPUT) == 0).alias("nowhere"))
    sent = sent.withColumn(OUTPUT, F.explode(OUTPUT))
    sent = sent.observe(seen, F.lit(0).alias("_"), *(F.count_if(F.col(OUTPUT) == name).alias(name) for name in outputs))
    sent.write.partitionBy(OUTPUT).option("header", "true").csv(folder)
    counts = {k: v for k, v in seen.get.items() if k != "_"}
    if given.get["nowhere"]:
        raise ValueError(f"{given.get['nowhere']} rows belong to no output")
    table.publish(base, {name: f"{folder}/{OUTPUT}={name}" for name in outputs if counts[name]} | {name: "" for name in outputs if not counts[name]})
    return counts


def read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The newest publication's rows of one output."""
    table = _manifests(spark, path)
    folder = table._read(table.version())["buckets"][name]
    return spark.read.schema(schema).option("header", "true").csv(folder) if folder else spark.createDataFrame([], schema)
