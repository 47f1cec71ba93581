"""Entries are told apart in order: no hash table holds a row for each of them."""

import re

from oracle import difference
from pyspark.sql import functions as F
from tallyspark.operators import ledger
from tallyspark.plans.queries import QUERIES, SQL
from tallyspark.sources import adapters as A

SF = "/root/testdata/sf0.001"


def test_no_table_of_entries(spark):
    for name in ("a4_category_totals", "a11_verification"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
        keys = re.findall(r"Aggregate\(keys?=\[([^\]]*)\]", plan)
        assert keys and not any("line#" in k for k in keys), name
        assert difference(spark, QUERIES[name], SQL[name], SF) is None


def test_entries_that_repeat(spark):
    """Repeated lines count once a batch and account, rows without a line not at all; sums are those by batch."""
    rows = A.allocations(spark, SF).where("batch_id < 200")
    rows = rows.unionByName(rows.where("line = 2")).unionByName(rows.where("line = 3").withColumn("line", F.lit(None).cast("int")))
    chart = A.classification(spark)
    got, want = (ledger.category_totals(f(rows, chart)).orderBy("category").collect() for f in (ledger.by_class, ledger.by_account))
    assert got == want and sum(r.n_entries for r in got) < sum(r.n_allocations for r in got)
    empty = ledger.verify(A.entries(spark, SF), A.batches(spark, SF), rows.limit(0), A.projects(spark, SF), 1).first()
    assert (empty.n_covered, empty.n_allocations, empty.link_percent) == (0, 0, 0.0)
