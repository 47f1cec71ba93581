"""The driver's tables as ledger tables: projections only, the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ACCOUNT = """case when l_returnflag = 'R' then '7777' when p_type like 'ECONOMY%' then '3000' when p_type like 'LARGE%' then '5000'
 when p_type like 'MEDIUM%' then '5100' when p_type like 'PROMO%' then '5200' when p_type like 'SMALL%' then '5300' else '9999' end"""
#: (organization, integration or null for the organization's own, account, category, sign, counts in the result, active)
CLASSIFICATION = """(1, 1, '3000', 'revenue', -1, true, true), (1, 2, '3000', 'revenue', -1, true, true),
 (1, null, '5000', 'labor_cost', 1, true, true), (1, 1, '5000', 'material_cost', 1, true, true), (1, null, '5100', 'subcontractor_cost', 1, true, true),
 (1, null, '5200', 'labor_cost', 1, true, true), (1, 2, '5200', 'labor_cost', 1, false, true), (1, null, '5300', 'overhead', 1, true, true),
 (1, null, '9999', 'excluded', 1, true, true), (1, null, '7777', 'tax', 1, true, false), (2, null, '3000', 'revenue', -1, true, true),
 (2, null, '5000', 'equipment_cost', 1, true, true), (2, 3, '5000', 'other_direct_cost', 1, true, true), (2, null, '5100', 'transport_cost', 1, true, true)"""
CHART = "organization_id, integration_id, account_code, category, sign, included, is_active"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(spark, sf_dir) -> DataFrame:
    """(batch_id, organization_id, integration_id, batch_date or null, currency or blank, project_id, sync_run_id)"""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS batch_id",
        "CASE WHEN (o_custkey % 10 = 9) <> (o_orderkey % 50 = 7) THEN 2 ELSE 1 END AS organization_id",
        "CASE WHEN (o_custkey % 10 = 9) <> (o_orderkey % 50 = 7) THEN 3 ELSE 1 + o_orderkey % 2 END AS integration_id",
        "CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS batch_date",
        "CASE WHEN o_orderkey % 33 = 0 THEN '' WHEN o_custkey % 4 = 0 AND o_orderkey % 20 = 0 THEN 'USD' ELSE 'EUR' END AS currency",
        "o_custkey AS project_id",
        "CASE WHEN o_orderkey % 5 <> 0 THEN 100 + o_orderkey % 3 END AS sync_run_id",
    )


def projects(spark, sf_dir) -> DataFrame:
    """(project_id, organization_id, code, name, status)"""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS project_id",
        "CASE WHEN c_custkey % 10 = 9 THEN 2 ELSE 1 END AS organization_id",
        "CAST(10000 + c_custkey AS STRING) AS code",
        "c_name AS name",
        "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'active' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'completed' ELSE 'archived' END AS status",
    )


def entries(spark, sf_dir) -> DataFrame:
    """(batch_id, line, part, account_code, amount): revenue stands in credit, so its amount is negative."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    amount = F.col("l_extendedprice").cast("decimal(20,6)")
    both = lines.join(parts, lines.l_partkey == parts.p_partkey).withColumn("account_code", F.expr(ACCOUNT))
    return both.select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        "account_code",
        F.when(F.col("account_code") == "3000", -amount).otherwise(amount).cast("decimal(20,6)").alias("amount"),
    )


def allocations(spark, sf_dir) -> DataFrame:
    """Entries with their batch, one allocation each but for the last line; some know their project by its code alone."""
    rows = entries(spark, sf_dir).where("line <> 7").join(batches(spark, sf_dir), "batch_id")
    known = F.when(F.col("line") % 6 != 5, F.col("project_id"))
    return rows.withColumn("dimension_code", (10000 + F.col("project_id")).cast("string")).withColumn("project_id", known)


def classification(spark) -> DataFrame:
    """The chart of accounts; its size is known to the planner."""
    return spark.sql(f"SELECT * FROM VALUES {CLASSIFICATION} AS t({CHART})")


def bills(spark, sf_dir) -> DataFrame:
    """(bill_id, number, amount, issuer, bill_date, kind, iban, subject, attachment_names, status)"""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).selectExpr(
        "o_orderkey AS bill_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('1996-', o_orderkey) ELSE concat('INV', o_orderkey) END AS number",
        "CAST(o_totalprice AS DECIMAL(20,2)) AS amount",
        "concat(c_name, ' OÜ') AS issuer",
        "CAST(o_orderdate AS DATE) AS bill_date",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'sale' ELSE 'purchase' END AS kind",
        "concat('EE', lpad(CAST(o_custkey AS STRING), 18, '7')) AS iban",
        "concat('Arve ', o_orderkey % 1000) AS subject",
        "concat('doc', o_orderkey, '.pdf') AS attachment_names",
        "CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status",
    )


def bank(spark, sf_dir) -> DataFrame:
    """(txn_id, amount, party, remittance, booking_date, direction, iban, currency): the bills' payments, some missing, off or without a number."""
    return bills(spark, sf_dir).where("bill_id % 7 <> 0").selectExpr(
        "bill_id AS txn_id",
        "CAST(amount + CASE WHEN bill_id % 11 = 0 THEN 1 WHEN bill_id % 13 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(20,2)) AS amount",
        "CASE WHEN bill_id % 6 = 0 THEN concat('OÜ ', replace(issuer, ' OÜ', '')) ELSE issuer END AS party",
        "CASE WHEN bill_id % 5 = 0 THEN 'payment' WHEN bill_id % 5 = 1 THEN concat('Arve ', bill_id % 1000) ELSE concat('Arve ', number) END AS remittance",
        "date_add(bill_date, 14) AS booking_date",
        "CASE WHEN kind = 'sale' THEN 'CRDT' ELSE 'DBIT' END AS direction",
        "CASE WHEN bill_id % 2 = 0 THEN iban END AS iban",
        "CASE WHEN bill_id % 20 = 0 THEN 'USD' ELSE 'EUR' END AS currency",
    )


#: The same projections for DuckDB.
SQL = f"""
batches AS (SELECT o_orderkey batch_id, CASE WHEN (o_custkey % 10 = 9) <> (o_orderkey % 50 = 7) THEN 2 ELSE 1 END organization_id,
 CASE WHEN (o_custkey % 10 = 9) <> (o_orderkey % 50 = 7) THEN 3 ELSE 1 + o_orderkey % 2 END integration_id,
 CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END batch_date,
 CASE WHEN o_orderkey % 33 = 0 THEN '' WHEN o_custkey % 4 = 0 AND o_orderkey % 20 = 0 THEN 'USD' ELSE 'EUR' END currency, o_custkey project_id,
 CASE WHEN o_orderkey % 5 <> 0 THEN 100 + o_orderkey % 3 END sync_run_id FROM orders),
projects AS (SELECT c_custkey project_id, CASE WHEN c_custkey % 10 = 9 THEN 2 ELSE 1 END organization_id, CAST(10000 + c_custkey AS VARCHAR) code, c_name AS name,
 CASE WHEN c_mktsegment IN ('AUTOMOBILE','BUILDING','FURNITURE') THEN 'active' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'completed' ELSE 'archived' END status FROM customer),
coded AS (SELECT l_orderkey batch_id, l_linenumber line, l_partkey part, {ACCOUNT} account_code, CAST(l_extendedprice AS DECIMAL(20,6)) price
 FROM lineitem JOIN part ON l_partkey = p_partkey),
entries AS (SELECT batch_id, line, part, account_code, CASE WHEN account_code = '3000' THEN -price ELSE price END amount FROM coded),
classification({CHART}) AS (VALUES {CLASSIFICATION}),
allocations AS (SELECT e.batch_id, e.line, e.part, e.account_code, e.amount, b.organization_id, b.integration_id, b.batch_date, b.currency, b.sync_run_id,
 CASE WHEN line % 6 <> 5 THEN b.project_id END project_id, CAST(10000 + b.project_id AS VARCHAR) dimension_code FROM entries e JOIN batches b ON e.batch_id = b.batch_id WHERE line <> 7),
star AS (SELECT a.*, p.code FROM allocations a JOIN projects p ON p.project_id = a.project_id AND p.organization_id = a.organization_id),
classed AS (SELECT s.*, coalesce(i.category, g.category, 'unclassified') category, coalesce(i.sign, g.sign, 1) sign, coalesce(i.included, g.included, true) included
 FROM star s LEFT JOIN classification i ON i.is_active AND i.organization_id = s.organization_id AND i.account_code = s.account_code AND i.integration_id = s.integration_id
 LEFT JOIN classification g ON g.is_active AND g.organization_id = s.organization_id AND g.account_code = s.account_code AND g.integration_id IS NULL),
routed AS (SELECT *, amount * sign AS normalized, CASE WHEN category = 'unclassified' THEN 'unclassified' WHEN category = 'excluded' OR NOT included THEN 'excluded'
 WHEN category = 'revenue' THEN 'revenue' WHEN category IN ('material_cost','subcontractor_cost','labor_cost','equipment_cost','transport_cost','other_direct_cost','overhead') THEN 'cost' ELSE 'dropped' END bucket FROM classed),
bills AS (SELECT o_orderkey bill_id, CASE WHEN o_orderkey % 3 = 0 THEN '1996-' || o_orderkey ELSE 'INV' || o_orderkey END AS number, CAST(o_totalprice AS DECIMAL(20,2)) amount,
 c_name || ' OÜ' issuer, CAST(o_orderdate AS DATE) bill_date, CASE WHEN o_orderkey % 4 = 0 THEN 'sale' ELSE 'purchase' END kind, 'EE' || lpad(CAST(o_custkey AS VARCHAR), 18, '7') iban,
 'Arve ' || (o_orderkey % 1000) subject, 'doc' || o_orderkey || '.pdf' attachment_names, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END status
 FROM orders JOIN customer ON o_custkey = c_custkey),
bank AS (SELECT bill_id txn_id, CAST(amount + CASE WHEN bill_id % 11 = 0 THEN 1 WHEN bill_id % 13 = 0 THEN 0.01 ELSE 0 END AS DECIMAL(20,2)) amount,
 CASE WHEN bill_id % 6 = 0 THEN 'OÜ ' || replace(issuer, ' OÜ', '') ELSE issuer END party,
 CASE WHEN bill_id % 5 = 0 THEN 'payment' WHEN bill_id % 5 = 1 THEN 'Arve ' || (bill_id % 1000) ELSE 'Arve ' || number END remittance, bill_date + 14 AS booking_date,
 CASE WHEN kind = 'sale' THEN 'CRDT' ELSE 'DBIT' END direction, CASE WHEN bill_id % 2 = 0 THEN iban END iban, CASE WHEN bill_id % 20 = 0 THEN 'USD' ELSE 'EUR' END currency FROM bills WHERE bill_id % 7 <> 0)
"""
