"""Entries of versions and targets: written in few bytes, and told off pair by pair."""

from pathlib import Path

from pyspark.sql import functions as F
from tallyspark.operators import allocation as L
from tallyspark.plans.queries import QUERIES

NAMES = ("j6_allocation_inflow", "a8_allocation_breakdown")


def test_bytes_of_an_entry(spark, tmp_path):
    """1500 approved versions and 8000 customers of one remainder."""
    spark.range(1000).selectExpr("id * 50 + 7 AS s_suppkey").write.parquet(f"file://{tmp_path}/supplier.parquet")
    spark.range(8000).selectExpr("id * 50 + 7 AS c_custkey").write.parquet(f"file://{tmp_path}/customer.parquet")
    for name in NAMES:
        rows = QUERIES[name](spark, f"file://{tmp_path}")
        rows.write.parquet(f"file://{tmp_path}/{name}")
        n = spark.read.parquet(f"file://{tmp_path}/{name}").select("project_id", "version_id").distinct().count()
        assert n == 1500 * 8000
        assert sum(f.stat().st_size for f in Path(tmp_path, name).glob("*.parquet")) / n < 0.4, name


def test_runs_hold_every_version_once(spark):
    v = spark.range(3000).selectExpr("id * 100 + 1 AS version_id", "id % 2 AS k", "IF(id < 600, NULL, id DIV 2 % 3) AS rv")
    v = v.unionByName(v.where("version_id < 1000"))  # ten versions twice
    r = L.runs(v, "k", "rv").cache()
    assert r.select(F.max(F.size("_rows"))).first()[0] == L.RUN and r.count() < 3010 / L.RUN + 18
    assert r.select("k", "rv", F.inline("_rows")).exceptAll(v.select("k", "rv", "version_id")).count() == 0 and r.agg(F.sum(F.size("_rows"))).first()[0] == 3010


def test_entries_leave_the_join_pair_by_pair(spark):
    """The join's generated code ends before entries arise: it would hold those of a run and all targets of a block at once."""
    for name in NAMES:
        lines = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString().split("\n")
        at = [next(i for i, x in enumerate(lines) if w in x) for w in ("Generate", "Coalesce", "ShuffledHashJoin")]
        assert at == sorted(at), name
