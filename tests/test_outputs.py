"""Several outputs in one commit: counts, empty outputs, failing tasks and rows without an output."""

import pytest
from pyspark.sql import functions as F
from tallyspark.sources import outputs

CASES = {"even": "i % 2 = 0", "odd": "i % 2 = 1", "small": "i < 10", "none": "i < 0"}


def numbers(spark, path, name):
    return sorted(r.i for r in outputs.read(spark, path, name, "i long, t string").collect())


def test_all_or_nothing(spark, tmp_path):
    kinds = {k: F.expr(c) for k, c in CASES.items()}
    path, rows = f"file://{tmp_path}/o", spark.range(100).select(F.col("id").alias("i"), F.lit('a,"b"').alias("t"))
    assert outputs.publish(rows, path, kinds) == {"even": 50, "odd": 50, "small": 10, "none": 0}
    assert numbers(spark, path, "odd") == list(range(1, 100, 2)) and numbers(spark, path, "none") == []
    assert {r.t for r in outputs.read(spark, path, "small", "i long, t string").collect()} == {'a,"b"'}
    broken = rows.withColumn("t", F.when(F.col("i") == 77, F.raise_error("lost")).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        outputs.publish(broken, path, kinds)
    with pytest.raises(ValueError, match="50 rows belong to no output"):
        outputs.publish(rows.withColumn("t", F.lit("new")), path, {"even": kinds["even"], "unknown": F.lit(None).cast("boolean")})
    assert {r.t for r in outputs.read(spark, path, "even", "i long, t string").collect()} == {'a,"b"'}
    assert outputs.publish(rows.limit(0), path, kinds) == {"even": 0, "odd": 0, "small": 0, "none": 0}
    assert numbers(spark, path, "even") == []
