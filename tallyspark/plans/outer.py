"""Queries on outer formats: pulls, payments, payloads, manifests, documents, audit, and bundles of a project's records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import adapters as A, files
from ..sources.shared import spread
from .registry import doubles, query

IBAN = "EE382200221020145685"


@query("s6_flattened_pull", "SELECT CAST(batch_id AS VARCHAR) batch_id, DATE '1995-01-01' batch_date, 'EUR' currency, CAST(line AS VARCHAR) entry_id, account_code, CAST(amount AS DOUBLE) debit, CAST(NULL AS DOUBLE) credit, CASE WHEN line % 2 = 0 THEN 'P' || part END dimension_code, CASE WHEN line % 2 = 0 THEN CAST(amount AS DOUBLE) END amount FROM entries")
def s6(spark, d):
    """Ledger batches as the nested JSON that a provider sends, flattened again."""
    money = F.col("amount").cast("string")
    split = F.when(F.col("line") % 2 == 0, F.array(F.struct(F.concat(F.lit("P"), "part").alias("Code"), money.alias("Amount"))))
    own = F.struct(F.when(F.col("line") % 3 == 0, F.col("line").cast("string")).alias("EntryId"), F.col("line").cast("string").alias("Id"), F.col("account_code").alias("AccountCode"), money.alias("Debit"), split.alias("Allocations"))
    e = A.entries(spark, d).groupBy("batch_id").agg(F.collect_list(own).alias("Entries"))
    raw = e.select(F.to_json(F.array(F.struct(F.col("batch_id").cast("string").alias("GLBId"), F.lit("1995-01-01").alias("BatchDate"), F.lit("EUR").alias("CurrencyCode"), "Entries"))).alias("json"))
    return doubles(files.flatten_pull(raw))


@query("s7_flattened_dimensions", "SELECT CAST(s_suppkey % 5 AS VARCHAR) AS dimension, 'v' || s_suppkey external_id, CAST(20000 + s_suppkey AS VARCHAR) code, s_name AS name FROM supplier", False)
def s7(spark, d):
    value = F.struct(F.concat(F.lit("v"), "s_suppkey").alias("DimValueId"), (20000 + F.col("s_suppkey")).cast("string").alias("Code"), F.col("s_name").alias("DimValueName"))
    g = A.table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 5).cast("string").alias("Id")).agg(F.collect_list(value).alias("Values"))
    one = F.when(F.col("Id") < "3", F.to_json(F.array(F.struct("Id", "Values")))).otherwise(F.to_json(F.struct(F.array(F.struct("Id", "Values")).alias("Dimensions"))))
    return files.flatten_dimensions(g.select(one.alias("json")))


@query("s13_electronic_bills", "SELECT bill_id, CAST(amount AS VARCHAR) amount_total, CASE WHEN bill_id % 2 = 0 THEN '1.50' ELSE '' END vat_amount, CAST(bill_date AS VARCHAR) invoice_date, '' due_date, CAST(bill_id AS VARCHAR) issuer_reg_code, '' issuer_vat_no, iban payment_details FROM bills")
def s13(spark, d):
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    total = F.when(F.col("bill_id") % 3 == 0, tag("PayableAmount", F.regexp_replace(F.col("amount").cast("string"), r"\.", ","))).otherwise(tag("totalsum", F.col("amount").cast("string")))
    x = F.concat(F.lit("<E xmlns='urn:x'>"), total, F.when(F.col("bill_id") % 2 == 0, F.lit("<TaxAmount>1,50</TaxAmount>")).otherwise(""), tag("IssueDate", F.date_format("bill_date", "dd.MM.yyyy")), tag("RegNumber", F.col("bill_id").cast("string")), tag("IBAN", "iban"), F.lit("</E>"))
    return files.e_invoice(spread(A.bills(spark, d)).select("bill_id", x.alias("x")), "x", "bill_id")


@query("s16_payments", f"""SELECT bill_id payment_id, CASE WHEN bill_id % 9 = 0 THEN 'amount' WHEN bill_id % 5 = 0 THEN 'iban' END error, CASE WHEN bill_id % 9 <> 0 AND bill_id % 5 <> 0 THEN CAST(amount AS DOUBLE) END amount, greatest(bill_date, DATE '1996-06-30') execution_date,
 CASE WHEN bill_id % 9 <> 0 AND bill_id % 5 <> 0 THEN '<PmtInf><PmtInfId>' || left('PMT-' || bill_id || '-' || number, 35) || '</PmtInfId><PmtMtd>TRF</PmtMtd><BtchBookg>true</BtchBookg><NbOfTxs>1</NbOfTxs><CtrlSum>' || amount || '</CtrlSum><PmtTpInf><SvcLvl><Cd>SEPA</Cd></SvcLvl></PmtTpInf><ReqdExctnDt>' || greatest(bill_date, DATE '1996-06-30') || '</ReqdExctnDt><Dbtr><Nm>Own &amp; Co</Nm></Dbtr><DbtrAcct><Id><IBAN>{IBAN}</IBAN></Id></DbtrAcct><ChrgBr>SLEV</ChrgBr><CdtTrfTxInf><PmtId><EndToEndId>' || number || '</EndToEndId></PmtId><Amt><InstdAmt Ccy="EUR">' || amount || '</InstdAmt></Amt><Cdtr><Nm>' || replace(issuer, '#', '') || '</Nm></Cdtr><CdtrAcct><Id><IBAN>{IBAN}</IBAN></Id></CdtrAcct><RmtInf><Ustrd>Arve ' || number || '</Ustrd></RmtInf></CdtTrfTxInf></PmtInf>' END xml FROM bills""")
def s16(spark, d):
    b, k = A.bills(spark, d), F.col("bill_id")
    rows = b.select(k.alias("payment_id"), "number", F.when(k % 9 == 0, "0").otherwise(F.col("amount").cast("string")).alias("amount"), F.when(k % 5 == 0, "EE12").otherwise(IBAN).alias("iban"), F.col("issuer").alias("party"), F.col("bill_date").cast("string").alias("due_date"), F.lit("EUR").alias("currency"))
    return doubles(files.payments(rows, IBAN, "Own & Co", "1996-06-30"))


@query("s17_payloads", """SELECT o_orderkey bill_id, '{"number":"' || CASE WHEN o_orderkey % 3 = 0 THEN '1996-' || o_orderkey ELSE 'INV' || o_orderkey END || '","issuer":"' || c_name || ' OÜ","total":"' || CAST(o_totalprice AS DECIMAL(20,2)) || '"' || coalesce(',"rows":[' || r || ']', '') || '}' payload FROM orders JOIN customer ON o_custkey = c_custkey
 LEFT JOIN (SELECT l_orderkey, string_agg('{"line":' || l_linenumber || ',"description":"' || l_partkey || '","quantity":' || CAST(l_quantity AS BIGINT) || ',"cents":' || CAST(round(l_extendedprice * 100) AS BIGINT) || '}', ',' ORDER BY l_linenumber, l_partkey::VARCHAR, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""", False)
def s17(spark, d):
    lines = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("description"), F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return files.bill_payloads(A.bills(spark, d), lines, ["line", "description", "quantity", "cents"])


@query("s18_archive_manifest", "SELECT bill_id, attachment_names AS source, strftime(bill_date, '%Y/%m') || '/' || CASE kind WHEN 'sale' THEN 'muugiarved' ELSE 'ostuarved' END || '/' || number || '_' || replace(issuer, '#', '_') || '.pdf' target FROM bills WHERE status = 'confirmed'")
def s18(spark, d):
    return files.archive_manifest(A.bills(spark, d))


@query("s19_stored_documents", "SELECT 'page' || page_id || '.html' AS path, sha256(html) sha256, strlen(html) size, 'text/html' mime, 1 AS version FROM pages", False)
def s19(spark, d):
    return files.store_documents(A.table(spark, d, "pages").select(F.concat(F.lit("page"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content")))


@query("s20_audit_rows", "SELECT 'bill_confirmed' event_type, 'Bill' object_type, CAST(bill_id AS VARCHAR) object_id, 1 organization_id, 'user' actor, bill_date AS at, 'Confirmed ' || number AS message, '{\"number\":\"' || number || '\"}' metadata FROM bills WHERE status = 'confirmed'")
def s20(spark, d):
    rows = A.bills(spark, d).where("status = 'confirmed'").select(F.col("bill_id").alias("object_id"), F.lit(1).alias("organization_id"), F.lit("user").alias("actor"), F.col("bill_date").alias("at"), F.create_map(F.lit("number"), F.col("number")).alias("metadata"), "number")
    return files.audit_rows(rows.drop("number"), "bill_confirmed", "Bill", F.concat(F.lit("Confirmed "), F.col("metadata")["number"]))


# Bundles: a project is a customer; its bills, payments, messages and questions are records of six kinds.
KINDS = """SELECT o_custkey project, 'bill' kind, o_orderkey id FROM orders UNION ALL SELECT o_custkey, 'payment', o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT user_id, event_type, event_id FROM events"""


@query("j30_project_bundles", f"WITH k AS ({KINDS}) SELECT project, kind, count(*) n, min(id) first_id, max(id) last_id FROM k GROUP BY 1, 2", False)
def j30(spark, d):
    """What a project's bundle holds of each kind; its records stay rows, so that no bundle is one value."""
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"))
    parts = [("bill", o), ("payment", o.where("id % 7 <> 0"))]
    rows = None
    for kind, part in parts:
        one = part.select("project", F.lit(kind).alias("kind"), "id")
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.unionByName(A.table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("kind"), F.col("event_id").alias("id")))
    return rows.groupBy("project", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("j31_conversation_context", "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) n_siblings, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role) before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role) AS after FROM conversations", False)
def j31(spark, d):
    from pyspark.sql import Window as W

    c = A.table(spark, d, "conversations").select("conv_id", "turn", "role")
    w = W.partitionBy("conv_id").orderBy("turn", "role")
    n = c.groupBy("conv_id").agg(F.count("*").alias("n_siblings"))
    return c.join(n, "conv_id").select("conv_id", "turn", "role", "n_siblings", F.lag("turn").over(w).alias("before"), F.lead("turn").over(w).alias("after"))


@query("u5_audit_references", "SELECT 'Bill' object_type, o_orderkey object_id FROM orders WHERE o_orderkey % 4 = 0 UNION SELECT 'Project', c_custkey FROM customer WHERE c_custkey % 4 = 0 UNION SELECT 'Supplier', s_suppkey FROM supplier WHERE s_suppkey % 4 = 0", False)
def u5(spark, d):
    audit = A.table(spark, d, "orders").select((F.col("o_orderkey")).alias("object_id")).where("object_id % 4 = 0")
    out = None
    for kind, name, key in (("Bill", "orders", "o_orderkey"), ("Project", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey")):
        part = A.table(spark, d, name).select(F.lit(kind).alias("object_type"), F.col(key).alias("object_id")).join(audit, "object_id", "left_semi").select("object_type", "object_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


@query("u6_evidence_union", "SELECT 'link' kind, o_orderkey id, o_custkey subject FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'question', event_id, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'draft', event_id, user_id FROM events WHERE event_type = 'signup'", False)
def u6(spark, d):
    e = A.table(spark, d, "events").select(F.when(F.col("event_type") == "click", "question").when(F.col("event_type") == "signup", "draft").alias("kind"), F.col("event_id").alias("id"), F.col("user_id").alias("subject")).where("kind is not null")
    o = A.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.lit("link").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"))
    return o.unionByName(e)
