"""Sums over classes of versions and targets against the same rule's entries, one by one."""

from pyspark.sql import functions as F
from tallyspark.operators import allocation as L
from tallyspark.plans import allocations as P

RULE, LISTED = P.RULE, [(1995, 1), (1995, 2), (1995, 3)]
MONEY = "decimal(20,6)"


def tables(spark):
    v = spark.range(40).selectExpr(
        "id * 100 + 1 + id % 4 AS version_id", "CASE WHEN id % 10 = 9 THEN 2 ELSE 1 END AS organization_id", "1995 AS year", "CAST(1 + id % 4 AS INT) AS month", "CASE id % 3 WHEN 0 THEN 'draft' ELSE 'approved' END AS status",
        "CASE WHEN id % 5 <> 0 THEN id % 3 END AS pool_id", "CASE WHEN id % 5 = 0 THEN id END AS source_project_id", "id % 7 AS k", "id * 1300 % 1000 AS rv",
    )
    t = spark.range(120).unionByName(spark.range(3, 5)).selectExpr("id AS project_id", "id % 7 AS k", "id * 7 % 20 AS rt", "id % 4 = 0 AS manual")  # two targets twice
    entries = v.select("version_id", "k", "rv").join(t, "k").select("version_id", "project_id", F.expr(RULE.amount).alias("amount"), "manual")
    return v, t, entries


def same(a, b):
    names = sorted(a.columns)
    rows = lambda df: sorted(tuple(float(x) if hasattr(x, "as_tuple") else str(x) for x in r) for r in df.select(*names).collect())
    assert sorted(b.columns) == names and rows(a) == rows(b) and a.count()


def test_entries_and_breakdown(spark):
    v, t, entries = tables(spark)
    inside, approved = L.in_months(entries, v, LISTED), L.of_status(v, LISTED)
    same(L.expanded(approved, t, RULE).select("version_id", "project_id", "amount"), inside.select("version_id", "project_id", "amount"))
    same(L.rule_breakdown(approved, t, RULE), L.breakdown(inside))


def test_results(spark):
    v, t, entries = tables(spark)
    results = spark.range(130).select(F.col("id").alias("project_id"), F.lit(50).cast(MONEY).alias("revenue"), F.lit(20).cast(MONEY).alias("cost"), F.lit(30).cast(MONEY).alias("result"), F.lit(60.0).alias("margin"), F.lit("complete").alias("quality"))
    mine, plain = L.rule_management_result(results, v, t, RULE, LISTED), L.management_result(results, entries, v, LISTED)
    same(mine, plain)
    months = results.select("project_id", "revenue", "cost").withColumn("month", F.explode(F.array(*(F.make_date(F.lit(1995), F.lit(m), F.lit(1)) for m in (1, 2, 3, 4)))))
    same(L.rule_month_rows(months, v, t, RULE, LISTED), L.month_rows(months, entries, v, LISTED))
    same(L.preview(L.received(L.of_status(v, LISTED, "draft"), t, RULE), mine), L.preview(L.in_months(entries, v, LISTED, "draft"), plain))
    same(L.list_summary(v, L.given(v, t, RULE)), L.list_summary(v, entries))


def test_validation(spark):
    v, t, entries = tables(spark)
    v = v.withColumn("source", F.when(F.col("version_id") % 2 == 0, F.lit(1)).otherwise(L.given(v, t, RULE).agg(F.max("amount")).first()[0]).cast(MONEY))
    p = spark.range(118).selectExpr("id AS project_id", "CASE WHEN id % 7 = 6 THEN 2 ELSE 1 END AS organization_id")
    for targets in (t, t.distinct()):
        of = entries if targets is t else entries.distinct()
        same(L.rule_validate(v, targets, RULE, p), L.validate(v, of, p))


def test_no_entry_is_shuffled(spark):
    """Sums of what 3 million pairs give move classes and rows of the two sides only."""
    v = spark.range(3000).selectExpr("id AS version_id", "id AS source_project_id", "0 AS k", "id % 10 AS rv")
    t = spark.range(1000).selectExpr("id AS project_id", "0 AS k", "id % 10 AS rt", "false AS manual")
    joined = L.given(v, t, RULE)
    assert joined.count() == 3000 and joined.agg(F.sum("n")).first()[0] == 3_000_000
    assert L.expanded(v, t, RULE).count() == 3_000_000
