"""Queries on predicates, orders, set operations, upserts and event folds."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D, fingerprint as FP, numeric as N
from ..operators import events as E, ledger, predicates as P, trees, upsert as U
from ..sources import adapters as A
from ..sources.shared import shared_dir, written
from ..sources.versioned import Table
from .registry import doubles, query

NOW = dt.date(1998, 6, 15)

# Candidates to review: one for each bill.
CANDIDATES = """bill_id AS id, CASE bill_id % 9 WHEN 0 THEN 'question' WHEN 1 THEN 'task_request' WHEN 2 THEN 'commitment' WHEN 3 THEN 'decision' WHEN 4 THEN 'risk' WHEN 5 THEN 'blocker' WHEN 6 THEN 'deadline' WHEN 7 THEN 'resolution_evidence' ELSE 'information_only' END AS kind,
 CASE bill_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'edited_and_approved' ELSE 'pending_review' END AS status, CASE bill_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS band,
 CASE WHEN bill_id % 6 = 0 THEN bill_date END AS snoozed_until, CASE WHEN bill_id % 7 = 0 THEN bill_date END AS suggested_due, CASE WHEN bill_id % 11 = 0 THEN bill_date END AS reviewed_due, bill_date AS reviewed_at,
 issuer AS title, CASE WHEN bill_id % 13 = 0 THEN number WHEN bill_id % 13 = 1 THEN '' END AS reviewed_title"""
ROWS = f"c AS (SELECT {CANDIDATES} FROM bills)"


def candidates(spark, d) -> DataFrame:
    from .text_fields import _split

    return A.bills(spark, d).selectExpr(*_split(CANDIDATES))


@query("p3_either_range", "SELECT bill_id FROM bills WHERE (bill_date >= DATE '1995-02-01' OR bill_date + 20 >= DATE '1995-02-01') AND (bill_date <= DATE '1995-03-01' OR bill_date + 20 <= DATE '1995-03-01')")
def p3(spark, d):
    return A.bills(spark, d).withColumn("sent", F.date_add("bill_date", 20)).where(P.either_in_range("bill_date", "sent", "1995-02-01", "1995-03-01")).select("bill_id")


@query("p5_search_by_id", "SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), '12') OR c_custkey = 12", False)
def p5(spark, d):
    return A.table(spark, d, "customer").where(P.search(" 12 ", ["c_name", "c_mktsegment"], "c_custkey")).select(F.col("c_custkey").alias("id"))


@query("p6_sort_parameter", "SELECT c_custkey AS id, CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN lower(c_mktsegment) ELSE 'margin' END sort FROM customer", False)
def p6(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), P.one_of(F.lower("c_mktsegment"), ["building", "machinery"], "margin").alias("sort"))


@query("p7_overlapping", "SELECT bill_id FROM bills WHERE bill_date <= DATE '1995-03-31' AND bill_date + 30 >= DATE '1995-03-01'")
def p7(spark, d):
    return A.bills(spark, d).withColumn("e", F.date_add("bill_date", 30)).where(P.overlaps("bill_date", "e", "1995-03-01", "1995-03-31")).select("bill_id")


@query("p8_awake", f", {ROWS} SELECT id FROM c WHERE snoozed_until IS NULL OR snoozed_until <= DATE '1996-01-01'")
def p8(spark, d):
    return candidates(spark, d).where(P.awake("snoozed_until", "1996-01-01")).select("id")


DUE = {"has_due_date": "suggested_due IS NOT NULL OR reviewed_due IS NOT NULL", "no_due_date": "suggested_due IS NULL AND reviewed_due IS NULL", "overdue": "suggested_due < DATE '1996-01-01' OR reviewed_due < DATE '1996-01-01'"}


@query("p9_due_filters", f", {ROWS} " + " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) n, sum(id)::BIGINT ids FROM c WHERE {v}" for k, v in DUE.items()))
def p9(spark, d):
    c, out = candidates(spark, d), None
    for k in DUE:
        part = c.where(P.due(k, "suggested_due", "reviewed_due", "1996-01-01")).agg(F.lit(k).alias("filter"), F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p10_effective_titles", f", {ROWS} SELECT id, coalesce(nullif(reviewed_title, ''), title) title FROM c")
def p10(spark, d):
    return candidates(spark, d).select("id", P.effective("reviewed_title", "title").alias("title"))


@query("p13_own_sales", "SELECT bill_id, subject LIKE 'x%' OR starts_with(lower(issuer), 'customer#000000001') OR lower(issuer) IN ('customer#000000002 oü') OR bill_id % 10 = 3 own FROM (SELECT bill_id, issuer, '' subject FROM bills)")
def p13(spark, d):
    b = A.bills(spark, d).withColumn("s", F.when(F.col("issuer").startswith("Customer#000000001"), F.lit("OWN Arve 7")).otherwise("Order")).withColumn("e", F.when(F.col("bill_id") % 10 == 3, "Bills@Own.ee").otherwise("x"))
    return b.select("bill_id", P.own_sale("s", "e", "issuer", ["own", "customer#000000002 oü"], ["bills@own.ee"]).alias("own"))


PERIODS = {"all": (None, None), "previous": ("1998-05-01", "1998-05-31"), "current": ("1998-06-01", "1998-06-15"), "year": ("1998-01-01", "1998-06-15"), "last3": ("1998-04-01", "1998-06-15")}


@query("p14_p15_periods", " ".join(["SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS period, count(*) n FROM bills WHERE bill_id % 8 <> 0" + (f" AND bill_date BETWEEN DATE '{a}' AND DATE '{b}'" if a else "") for k, (a, b) in PERIODS.items()) + ")"]))
def p14(spark, d):
    b = A.bills(spark, d).withColumn("written", F.when(F.col("bill_id") % 8 == 0, "no date").otherwise(F.concat(F.col("bill_date").cast("string"), F.lit("T10:00"))))
    return b.agg(*(F.count_if(P.in_period(F.col("written"), *P.period(k, NOW))).alias(k) for k in PERIODS)).unpivot([], list(PERIODS), "period", "n")


@query("p16_missing_codes", "SELECT bill_id FROM bills WHERE bill_id % 3 <> 1")
def p16(spark, d):
    code = F.when(F.col("bill_id") % 3 == 0, F.lit("  ")).when(F.col("bill_id") % 3 == 1, "25001")
    return A.bills(spark, d).withColumn("code", code).where(F.trim(F.coalesce("code", F.lit(""))) == "").select("bill_id")


@query("p17_safe_metadata", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ->> '$.k' END k FROM events", False)
def p17(spark, d):
    e = A.table(spark, d, "events").withColumn("m", P.safe_metadata(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise('{"secret": 1}'), ["k"]))
    return e.select("event_id", F.col("m")["k"].alias("k"))


LINKED = "SELECT DISTINCT bill_id FROM bills WHERE bill_id % 3 = 0"


@query("p18_inbox_filters", f", l AS ({LINKED}) SELECT b.bill_id, b.bill_id IN (SELECT bill_id FROM l) suggested, b.bill_id NOT IN (SELECT bill_id FROM l) no_project FROM bills b WHERE b.bill_id % 5 = 0")
def p18(spark, d):
    b = A.bills(spark, d)
    with_attachment = b.join(b.where("bill_id % 5 = 0").select("bill_id"), "bill_id", "left_semi")
    links = b.where("bill_id % 3 = 0").select("bill_id").distinct()
    some = with_attachment.join(links, "bill_id", "left_semi").select("bill_id", F.lit(True).alias("suggested"), F.lit(False).alias("no_project"))
    return some.unionByName(with_attachment.join(links, "bill_id", "left_anti").select("bill_id", F.lit(False).alias("suggested"), F.lit(True).alias("no_project")))


@query("p20_conflict_links", "SELECT event_id FROM events WHERE event_id % 3 = 0", False)
def p20(spark, d):
    evidence = F.when(F.col("event_id") % 3 == 0, F.lit('{"warnings": ["conflict"]}')).when(F.col("event_id") % 3 == 1, F.lit('{"matches": []}'))
    return A.table(spark, d, "events").where(F.get_json_object(evidence, "$.warnings").isNotNull()).select("event_id")


@query("a21_review_summary", f", {ROWS}, g AS (SELECT count(*) FILTER (WHERE status = 'pending_review') pending, count(*) FILTER (WHERE status = 'pending_review' AND band = 'high') high_confidence, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') {n}" for k, n in (("question", "questions"), ("task_request", "task_requests"), ("commitment", "commitments"), ("decision", "decisions"))) + """, count(*) FILTER (WHERE kind IN ('risk', 'blocker')) risks_blockers,
 count(*) FILTER (WHERE snoozed_until > DATE '1996-01-01') snoozed, count(*) FILTER (WHERE reviewed_at = DATE '1996-01-01') reviewed_today, count(*) FILTER (WHERE status IN ('approved', 'edited_and_approved')) approved, count(*) FILTER (WHERE status <> 'pending_review') reviewed FROM c) SELECT *, round_even(approved::DOUBLE / reviewed * 100, 0) approval_rate FROM g""")
def a21(spark, d):
    from ..operators.messages import review_summary

    return review_summary(candidates(spark, d), "1996-01-01")


for _name, _column in (("a22_candidates_by_type", "kind"), ("a25_status_counts", "status")):

    @query(_name, f", {ROWS} SELECT {_column}, count(*) n FROM c GROUP BY 1")
    def counts(spark, d, column=_column):
        return candidates(spark, d).groupBy(column).agg(F.count("*").alias("n"))


@query("a29_inbox_counts", "SELECT o_custkey message, count(DISTINCT o_orderkey) n_questions, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = o_custkey % 7) n_attachments FROM orders GROUP BY o_custkey", False)
def a29(spark, d):
    q = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("message")).agg(F.count_distinct("o_orderkey").alias("n_questions"))
    a = A.table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 7).alias("k")).agg(F.count("*").alias("n_attachments"))
    return q.withColumn("k", F.col("message") % 7).join(a, "k", "left").select("message", "n_questions", F.coalesce("n_attachments", F.lit(0)).alias("n_attachments"))


@query("a31_dashboard_cards", "SELECT (SELECT count(*) FROM projects) n_projects, (SELECT count(*) FROM projects WHERE status = 'active') n_active, (SELECT count(*) FROM bills) n_bills, (SELECT count(DISTINCT issuer) FROM bills) n_issuers, (SELECT count(*) FROM bills WHERE bill_date = DATE '1996-01-02') n_today, (SELECT count(*) FROM bank) n_payments")
def a31(spark, d):
    p = A.projects(spark, d).agg(F.count("*").alias("n_projects"), F.count_if(F.col("status") == "active").alias("n_active"))
    b = A.bills(spark, d).agg(F.count("*").alias("n_bills"), F.count_distinct("issuer").alias("n_issuers"), F.count_if(F.to_date(F.from_utc_timestamp(F.to_timestamp("bill_date"), "Europe/Tallinn")) == F.lit("1996-01-02")).alias("n_today"))
    return p.join(b, F.lit(True)).join(A.bank(spark, d).agg(F.count("*").alias("n_payments")), F.lit(True))  # three rows


@query("a33_mapping_summary", ", m AS (SELECT account_code, bool_or(category <> 'unclassified') mapped, bool_or(category = 'excluded') excluded FROM classed GROUP BY 1) SELECT count(*) n, count(*) FILTER (WHERE mapped) n_mapped, count(*) FILTER (WHERE NOT mapped) n_missing, count(*) FILTER (WHERE excluded) n_excluded FROM m")
def a33(spark, d):
    rows = ledger.by_account(ledger.base(A.allocations(spark, d), A.projects(spark, d)), A.classification(spark), "project_id")
    m = rows.groupBy("account_code").agg(F.bool_or(F.col("category") != "unclassified").alias("mapped"), F.bool_or(F.col("category") == "excluded").alias("excluded"))
    return m.agg(F.count("*").alias("n"), F.count_if("mapped").alias("n_mapped"), F.count_if(~F.col("mapped")).alias("n_missing"), F.count_if("excluded").alias("n_excluded"))


DIMS = "dims AS (SELECT s_suppkey dimension_id, 'D' || s_suppkey external_id, CAST(10000 + s_suppkey * 20 AS VARCHAR) code FROM supplier)"


def dims(spark, d) -> DataFrame:
    return A.table(spark, d, "supplier").selectExpr("s_suppkey AS dimension_id", "concat('D', s_suppkey) AS external_id", "CAST(10000 + s_suppkey * 20 AS STRING) AS code")


@query("a34_code_counts", f", {DIMS} SELECT count(*) FILTER (WHERE p.code IS NOT NULL AND q.code IS NOT NULL) n_linked, count(*) FILTER (WHERE p.code IS NULL) n_missing, count(*) FILTER (WHERE q.code IS NULL) n_workspace_only, count(*) n FROM projects p FULL JOIN dims q ON p.code = q.code")
def a34(spark, d):
    s = ledger.dimension_coverage(A.projects(spark, d), dims(spark, d))
    return s.agg(*(F.count_if(F.col("state") == k).alias(f"n_{k}") for k in ("linked", "missing", "workspace_only")), F.count("*").alias("n"))


for _name, _sql in (("u1_all_codes", "SELECT code FROM projects UNION SELECT code FROM dims"), ("u2_common_codes", "SELECT code FROM projects INTERSECT SELECT code FROM dims"), ("u2_other_codes", "SELECT code FROM projects EXCEPT SELECT code FROM dims")):

    @query(_name, f", {DIMS} {_sql}")
    def codes(spark, d, name=_name):
        p, q = A.projects(spark, d).select("code"), dims(spark, d).select("code")
        return {"u1_all_codes": p.union(q).distinct, "u2_common_codes": lambda: p.intersect(q), "u2_other_codes": lambda: p.subtract(q)}[name]()


@query("u3_either_scope", "SELECT DISTINCT a.account_code, a.integration_id FROM allocations a WHERE a.organization_id = 1 AND (a.project_id IS NULL OR a.integration_id IN (1, 2) AND a.currency <> '')")
def u3(spark, d):
    a = A.allocations(spark, d).where("organization_id = 1")
    return P.either(a, F.col("project_id").isNull(), F.col("integration_id").isin(1, 2) & (F.col("currency") != "")).select("account_code", "integration_id").distinct()


@query("u8_paged_pulls", "SELECT DISTINCT bill_id FROM bills WHERE bill_date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31'")
def u8(spark, d):
    """Overlapping pulls of at most 31 days each, put together without repeats."""
    b = A.bills(spark, d)
    windows = spark.range(1).select(F.explode(D.chunks(F.lit("1995-01-01").cast("date"), F.lit("1995-03-31").cast("date"))).alias("w")).select("w.start", F.date_add("w.end", 3).alias("end"))
    pulls = b.join(F.broadcast(windows.limit(1000)), F.col("bill_date").between(F.col("start"), F.col("end")))
    return pulls.where("bill_date <= date'1995-03-31'").dropDuplicates(["bill_id"]).select("bill_id")


@query("u9_missing_dimension_values", f", {DIMS} SELECT DISTINCT code FROM projects WHERE project_id % 2 = 0 AND code NOT IN (SELECT code FROM dims)")
def u9(spark, d):
    return A.projects(spark, d).where("project_id % 2 = 0").select("code").distinct().join(dims(spark, d).select("code"), "code", "left_anti")


# Orders and pages; the page is the feature.
ORDERS = {
    "o4_status_priority": ("CASE status WHEN 'pending' THEN 1 WHEN 'confirmed' THEN 2 WHEN 'rejected' THEN 3 ELSE 4 END, bill_date DESC, bill_id", lambda: [P.rank(F.col("status"), ["pending", "confirmed", "rejected"]), F.desc("bill_date"), F.asc("bill_id")]),
    "o8_latest_bills": ("bill_date DESC, bill_id DESC", lambda: [F.desc("bill_date"), F.desc("bill_id")]),
    "o10_register_order": ("CASE status WHEN 'pending' THEN 0 WHEN 'confirmed' THEN 1 ELSE 2 END, bill_date DESC, issuer, bill_id", lambda: [F.when(F.col("status") == "pending", 0).when(F.col("status") == "confirmed", 1).otherwise(2), F.desc("bill_date"), F.asc("issuer"), F.asc("bill_id")]),
    "o11_scan_order": ("bill_date DESC, amount DESC, bill_id", lambda: [F.desc("bill_date"), F.desc("amount"), F.asc("bill_id")]),
}
for _name, (_sql, _order) in ORDERS.items():

    @query(_name, f"SELECT bill_id, row_number() OVER (ORDER BY {_sql}) AS position FROM bills ORDER BY position LIMIT 100")
    def ordered(spark, d, order=_order):
        return P.page(A.bills(spark, d), order(), 100).select("bill_id", "position")


@query("o7_second_page", "SELECT bill_id, row_number() OVER (ORDER BY bill_id) AS position FROM bills ORDER BY position LIMIT 50 OFFSET 50")
def o7(spark, d):
    return P.page(A.bills(spark, d), [F.asc("bill_id")], 50, 50).select("bill_id", "position")


@query("o6_samples", "SELECT * FROM (SELECT bill_id, bill_id % 3 = 0 AS flag FROM bills WHERE bill_id % 3 = 0 ORDER BY bill_id LIMIT 5) UNION ALL SELECT * FROM (SELECT bill_id, false FROM bills WHERE bill_id % 3 <> 0 ORDER BY bill_id LIMIT 5)")
def o6(spark, d):
    return P.samples(A.bills(spark, d), F.col("bill_id") % 3 == 0, [F.asc("bill_id")], 5).select("bill_id", "flag")


@query("w13_chart_scale", """, t AS (SELECT s_suppkey id, s_acctbal v FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10), r AS (SELECT least(min(v), 0) lo, greatest(max(v), 0) hi FROM t)
SELECT id, round_even((least(v, 0) - lo) / (hi - lo) * 100, 2) AS offset, round_even(abs(v) / (hi - lo) * 100, 2) AS width FROM t, r""")
def w13(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    return P.chart_scale(s, "v", [F.desc("v"), F.asc("id")]).select("id", "offset", "width")


AXIS = """ranges AS (SELECT c_nationkey AS nation, greatest(max(c_acctbal), 0)::DOUBLE hi, least(min(c_acctbal), 0)::DOUBLE lo FROM customer GROUP BY 1),
steps AS (SELECT *, (hi - lo) / 5 AS target, pow(10.0, floor(log10((hi - lo) / 5))) AS scale FROM ranges),
nice AS (SELECT *, scale * CASE WHEN target / scale <= 1 THEN 1 WHEN target / scale <= 2 THEN 2 WHEN target / scale <= 2.5 THEN 2.5 WHEN target / scale <= 5 THEN 5 ELSE 10 END AS iv FROM steps)"""


@query("o12_axis_intervals", f"WITH {AXIS} SELECT nation, 0 - ceil(-lo / iv) * iv AS low, ceil(hi / iv) * iv AS high, iv AS interval, CAST(round((ceil(hi / iv) + ceil(-lo / iv))) + 1 AS BIGINT) AS n_ticks FROM nice", False)
def o12(spark, d):
    return P.axis(A.table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation"), "c_acctbal", "nation")


@query("n6_row_status", "SELECT bill_id, CASE WHEN bill_id % 4 = 0 OR paid >= amount THEN 'paid' WHEN paid > 0 THEN 'partially_paid' ELSE 'unpaid' END status FROM (SELECT *, CASE WHEN bill_id % 3 = 0 THEN 0 WHEN bill_id % 3 = 1 THEN amount ELSE 1 END paid FROM bills)")
def n6(spark, d):
    paid = F.when(F.col("bill_id") % 3 == 0, F.lit(0)).when(F.col("bill_id") % 3 == 1, F.col("amount")).otherwise(F.lit(1)).cast("decimal(20,2)")
    flag = F.when(F.col("bill_id") % 4 == 0, "true")
    return A.bills(spark, d).select("bill_id", N.row_status(flag, F.col("amount"), paid).alias("status"))


@query("n9_percents", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE replace(printf('%.2f', c_custkey / 4.0), '.', ',') || '%' END shown FROM customer", False)
def n9(spark, d):
    """Without spaces for thousands, as its SQL has it."""
    c = A.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), N.display_percent(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") / 4).cast("decimal(20,2)"), grouping=False).alias("shown"))


USED = "used AS (SELECT CAST(c_custkey AS VARCHAR) code FROM customer WHERE c_custkey <> 77 UNION ALL SELECT 'P-' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') FROM supplier WHERE s_suppkey <> 8)"


@query("n11_next_codes", f"WITH {USED} SELECT (SELECT CAST(max(c_custkey) + 1 AS VARCHAR) FROM customer) next_number, '77' next_from_50, (SELECT 'P-' || lpad(CAST(max(s_suppkey) + 1 AS VARCHAR), 5, '0') FROM supplier) next_prefixed, 'P-00008' next_from_3", False)
def n11(spark, d):
    used = A.table(spark, d, "customer").where("c_custkey <> 77").select(F.col("c_custkey").cast("string").alias("code")).union(A.table(spark, d, "supplier").where("s_suppkey <> 8").select(F.concat(F.lit("P-"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0"))))
    one = None
    for name, args in {"next_number": ("", None), "next_from_50": ("", 50), "next_prefixed": ("P-", None), "next_from_3": ("P-", 3)}.items():
        part = U.next_code(used, *args).select(F.col("code").alias(name))
        one = part if one is None else one.join(part, F.lit(True))  # single rows
    return one


@query("d4_quarters", "SELECT bill_id, CAST(q AS DATE) AS start, least(CAST(q + INTERVAL 3 MONTH AS DATE) - 1, bill_date + 200) AS \"end\" FROM (SELECT bill_id, bill_date, unnest(generate_series(date_trunc('year', bill_date), bill_date + 200, INTERVAL 3 MONTH)) q FROM bills)")
def d4(spark, d):
    b = A.bills(spark, d).select("bill_id", F.explode(D.quarters(F.col("bill_date"), F.date_add("bill_date", 200))).alias("q"))
    return b.select("bill_id", "q.*")


@query("d5_d12_month_bounds", "SELECT bill_id, CAST(date_trunc('month', bill_date) AS DATE) first, last_day(bill_date) AS last, CAST(date_trunc('month', bill_date) - INTERVAL 2 MONTH AS DATE) back, day(bill_date) < day(last_day(bill_date)) AS partial FROM bills")
def d5(spark, d):
    first, last = D.month_bounds(F.col("bill_date"))
    return A.bills(spark, d).select("bill_id", first.alias("first"), last.alias("last"), D.rolling_cutoff(F.col("bill_date"), 3).alias("back"), D.is_partial_month(F.col("bill_date")).alias("partial"))


@query("d8_later_dates", "SELECT bill_id, CASE bill_id % 3 WHEN 0 THEN CAST(bill_date + 3 AS VARCHAR) WHEN 1 THEN CAST(bill_date AS VARCHAR) ELSE '' END later FROM bills")
def d8(spark, d):
    k, day = F.col("bill_id") % 3, F.col("bill_date").cast("string")
    a, b = F.when(k == 2, "x").otherwise(day), F.when(k == 0, F.date_add("bill_date", 3).cast("string")).otherwise("none")
    return A.bills(spark, d).select("bill_id", D.later(a, b).alias("later"))


@query("d9_due_dates", "SELECT bill_id, CASE bill_id % 4 WHEN 0 THEN DATE '1997-07-20' WHEN 1 THEN bill_date + 1 WHEN 2 THEN bill_date + CAST((8 - isodow(bill_date) - 1 + 4) % 7 + 1 AS INTEGER) END due FROM bills")
def d9(spark, d):
    text = F.when(F.col("bill_id") % 4 == 0, "by 1997-07-20.").when(F.col("bill_id") % 4 == 1, "Palun homme").when(F.col("bill_id") % 4 == 2, "by Friday").otherwise("none")
    return A.bills(spark, d).select("bill_id", D.due_date(text, F.col("bill_date")).alias("due"))


@query("d7_net_dates", "SELECT bill_id, bill_date AS day FROM bills")
def d7(spark, d):
    ms = F.unix_millis(F.to_timestamp("bill_date"))
    text = F.when(F.col("bill_id") % 2 == 0, F.concat(F.lit("/Date("), ms.cast("string"), F.lit(")/"))).otherwise(F.concat(F.col("bill_date").cast("string"), F.lit("T00:00:00")))
    return A.bills(spark, d).select("bill_id", D.net_date(text).alias("day"))


@query("t36_flags", "SELECT bill_id, CASE bill_id % 4 WHEN 0 THEN true WHEN 1 THEN false END flag FROM bills")
def t36(spark, d):
    return A.bills(spark, d).select("bill_id", N.flag(F.when(F.col("bill_id") % 4 == 0, " Yes").when(F.col("bill_id") % 4 == 1, "0").when(F.col("bill_id") % 4 == 2, "maybe")).alias("flag"))


# Upserts.
PULLED = """pulled AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'N' ELSE 'D' END || s_suppkey external_id, CAST(10000 + CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey + 1 ELSE s_suppkey END * 20 AS VARCHAR) code FROM supplier WHERE s_suppkey % 3 <> 0),
bad AS (SELECT external_id, code FROM pulled WHERE code IN (SELECT code FROM pulled GROUP BY code HAVING count(*) > 1) UNION SELECT i.external_id, i.code FROM pulled i JOIN dims s ON i.code = s.code WHERE i.external_id <> s.external_id UNION SELECT i.external_id, i.code FROM pulled i JOIN dims s ON i.external_id = s.external_id WHERE i.code <> s.code)"""


def pulled(spark, d) -> DataFrame:
    return A.table(spark, d, "supplier").where("s_suppkey % 3 <> 0").selectExpr("concat(CASE WHEN s_suppkey % 5 = 0 THEN 'N' ELSE 'D' END, s_suppkey) AS external_id", "CAST(10000 + CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey + 1 ELSE s_suppkey END * 20 AS STRING) AS code")


@query("m3_dimension_sync", f", {DIMS}, {PULLED} SELECT i.external_id, i.code, CASE WHEN b.code IS NOT NULL THEN 'conflict' WHEN s.external_id IS NOT NULL THEN CASE WHEN s.code = i.code THEN 'unchanged' ELSE 'updated' END WHEN t.code IS NOT NULL THEN 'updated' ELSE 'created' END AS action FROM pulled i LEFT JOIN bad b ON b.external_id = i.external_id AND b.code = i.code LEFT JOIN dims s ON s.external_id = i.external_id LEFT JOIN dims t ON t.code = i.code UNION ALL SELECT external_id, code, 'archived' FROM dims WHERE external_id NOT IN (SELECT external_id FROM pulled) AND code NOT IN (SELECT code FROM pulled)")
def m3(spark, d):
    return U.sync_dimensions(dims(spark, d), pulled(spark, d))


@query("m4_dimension_values", f", {DIMS} SELECT coalesce(p.code, q.code) code, CASE WHEN q.code IS NULL THEN 'created' WHEN p.code IS NULL THEN 'absent' WHEN p.project_id % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS action, coalesce(CASE WHEN p.project_id % 2 = 0 THEN 'new' ELSE 'old' END, 'old') AS name FROM (SELECT * FROM projects WHERE project_id % 10 < 5) p FULL JOIN dims q ON p.code = q.code")
def m4(spark, d):
    fresh = A.projects(spark, d).where("project_id % 10 < 5").select("code", F.when(F.col("project_id") % 2 == 0, "new").otherwise("old").alias("name"))
    return U.diff(dims(spark, d).select("code", F.lit("old").alias("name")), fresh, "code", ["name"])


@query("m5_conflict_resolution", "SELECT s_suppkey id, CASE WHEN s_suppkey % 4 = 1 THEN 'B' ELSE 'A' END code, CASE s_suppkey % 4 WHEN 2 THEN 'inactive' WHEN 3 THEN 'in_review' ELSE 'active' END status FROM supplier", False)
def m5(spark, d):
    r = F.element_at(F.array(*map(F.lit, ("keep_local", "accept_incoming", "mark_inactive", "manual_review"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return U.resolve_conflicts(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), r.alias("resolution"), F.lit("A").alias("local_code"), F.lit("B").alias("incoming_code")))


@query("j29_conflict_dimensions", f", {DIMS} SELECT dimension_id conflict_id, CASE WHEN dimension_id % 2 = 0 THEN dimension_id ELSE (SELECT min(x.dimension_id) FROM dims x WHERE x.code = dims.code) END dimension_id FROM dims")
def j29(spark, d):
    x = dims(spark, d)
    c = x.select(F.col("dimension_id").alias("conflict_id"), F.when(F.col("dimension_id") % 2 == 0, F.array(F.lit("none"), F.col("external_id"))).otherwise(F.array(F.lit("none"))).alias("ids"), F.array("code").alias("codes"))
    return U.local_dimension(c, x)


@query("w10_first_seen", "WITH p AS (SELECT o_custkey % 100 code, o_orderkey % 3 AS id, o_orderkey pos FROM orders), f AS (SELECT code, arg_min(id, pos) first_id FROM p GROUP BY 1) SELECT p.code, p.id, f.first_id FROM p JOIN f USING (code) WHERE p.id <> f.first_id", False)
def w10(spark, d):
    o = A.table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("code"), (F.col("o_orderkey") % 3).alias("id"), F.col("o_orderkey").alias("pos"))
    return U.first_conflict(o, "code", "id", "pos")


@query("w12_first_occurrences", "SELECT o_custkey AS id, min(o_orderkey) AS position FROM orders GROUP BY 1", False)
def w12(spark, d):
    return A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("position"))


@query("m8_status_updates", "SELECT bill_id, CASE bill_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE status END status, CASE WHEN bill_id % 4 = 0 THEN bill_date + 1 END confirmed_at, CASE WHEN bill_id % 4 = 1 THEN bill_date + 1 END rejected_at FROM bills")
def m8(spark, d):
    b = A.bills(spark, d)
    change = b.where("bill_id % 4 < 2").select("bill_id", F.when(F.col("bill_id") % 4 == 0, "confirmed").otherwise("rejected").alias("new_status"), F.date_add("bill_date", 1).alias("at"))
    return U.set_status(b.select("bill_id", "status"), change, "bill_id")


@query("m9_settings", "WITH w AS (SELECT user_id % 50 AS key, arg_max(event_type, event_id) v FROM events GROUP BY 1) SELECT coalesce(w.key, s.key) AS key, coalesce(v, 'default') AS value FROM w FULL JOIN (SELECT c_custkey AS key FROM customer WHERE c_custkey <= 60) s ON s.key = w.key", False)
def m9(spark, d):
    stored = A.table(spark, d, "customer").where("c_custkey <= 60").select(F.col("c_custkey").alias("key"), F.lit("default").alias("value"))
    writes = A.table(spark, d, "events").select((F.col("user_id") % 50).alias("key"), F.col("event_type").alias("value"), "event_id")
    return U.last_write(stored, writes, "key", "value", "event_id")


@query("m12_pending_candidates", f", {ROWS}, s AS (SELECT id, status, band FROM c WHERE id % 3 <> 0), f AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'high' ELSE band END band FROM c WHERE id % 7 <> 0) SELECT coalesce(s.id, f.id) id, CASE WHEN s.id IS NULL THEN 'created' WHEN f.id IS NULL THEN 'absent' WHEN status <> 'pending_review' THEN 'skipped' WHEN s.band = f.band THEN 'unchanged' ELSE 'updated' END AS action, CASE WHEN s.id IS NULL OR (f.id IS NOT NULL AND status = 'pending_review') THEN f.band ELSE s.band END band FROM s FULL JOIN f ON s.id = f.id")
def m12(spark, d):
    c = candidates(spark, d)
    fresh = c.where("id % 7 <> 0").select("id", F.when(F.col("id") % 2 == 0, "high").otherwise(F.col("band")).alias("band"))
    return U.persist_pending(c.where("id % 3 <> 0").select("id", "status", "band"), fresh, "id", "band")


@query("m13_not_extracted", "SELECT doc_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0)", False)
def m13(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", "text")
    done = t.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("version"))
    return U.not_extracted(t, done, "text", 2).select("doc_id")


@query("m16_saved_classes", ", g AS (SELECT DISTINCT account_code FROM entries), s(account_code, was) AS (VALUES ('3000', 'revenue'), ('5000', 'labor_cost'), ('1111', 'tax')), n(account_code, category) AS (VALUES ('3000', 'revenue'), ('5000', 'material_cost'), ('7777', 'excluded'), ('0000', 'tax')), k AS (SELECT * FROM n WHERE account_code IN (SELECT account_code FROM g)) SELECT coalesce(s.account_code, k.account_code) account_code, coalesce(category, was) category, CASE WHEN category IS NULL THEN 'kept' WHEN was IS NULL THEN 'created' WHEN was = category THEN 'unchanged' ELSE 'updated' END AS action FROM s FULL JOIN k ON s.account_code = k.account_code")
def m16(spark, d):
    of = lambda rows: spark.createDataFrame(rows, "account_code string, category string")
    return U.save_classes(of([("3000", "revenue"), ("5000", "labor_cost"), ("1111", "tax")]), of([("3000", "revenue"), ("5000", "material_cost"), ("7777", "excluded"), ("0000", "tax")]), A.entries(spark, d))


@query("m17_payment_results", "SELECT o_custkey AS key, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'sent' END, o_orderkey) AS result FROM orders GROUP BY 1", False)
def m17(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "error").otherwise("sent").alias("result"), "o_orderkey")
    return U.last_write(o.select("key", "result").limit(0), o, "key", "result", "o_orderkey")


# Trees: a first pull of two batches in three, then one of every second batch with other amounts and some batches and lines gone.
TREE = """nodes AS (SELECT batch_id, CAST(batch_id AS VARCHAR) path, 'batch' kind, currency v FROM batches UNION ALL SELECT batch_id, concat(batch_id, '/', line), 'entry', CAST(min(amount) AS VARCHAR) FROM entries GROUP BY batch_id, line
 UNION ALL SELECT batch_id, concat(batch_id, '/', line, '/', dimension_code), 'allocation', min(account_code) FROM allocations GROUP BY batch_id, line, dimension_code),
one AS (SELECT * FROM nodes WHERE batch_id % 3 <> 0), two AS (SELECT n.batch_id, path, kind, CASE WHEN kind = 'entry' AND batch_id % 10 = 0 THEN v || '0' ELSE v END v FROM nodes n WHERE batch_id % 2 = 0),
gone AS (SELECT CAST(batch_id AS VARCHAR) path FROM batches WHERE batch_id % 7 = 0 UNION ALL SELECT concat(batch_id, '/', line) FROM entries WHERE batch_id % 11 = 0 AND line = 2),
put AS (SELECT coalesce(t.path, o.path) path, coalesce(t.kind, o.kind) kind, CASE WHEN t.path IS NULL THEN o.v ELSE t.v END v, CASE WHEN o.path IS NULL THEN 'created' WHEN t.path IS NULL THEN 'kept' WHEN o.v = t.v THEN 'unchanged' ELSE 'updated' END AS action
 FROM one o FULL JOIN two t ON t.path = o.path)"""


@query("m1_tree_upsert", f", {TREE} SELECT * FROM put b WHERE action <> 'kept' OR NOT (path IN (SELECT path FROM gone) OR regexp_extract(path, '^[^/]*') IN (SELECT path FROM gone) OR regexp_extract(path, '^[^/]*/[^/]*') IN (SELECT path FROM gone))")
def m1_tree(spark, d):
    batches, entries = A.batches(spark, d), A.entries(spark, d)
    levels = [(batches, "batch", ["batch_id"], "currency"), (entries, "entry", ["batch_id", "line"], "amount"), (A.allocations(spark, d), "allocation", ["batch_id", "line", "dimension_code"], "account_code")]
    all_ = None
    for rows, kind, ids, value in levels:
        part = trees.nodes(rows.groupBy(*ids).agg(F.min(value).alias("v")), kind, ids, ["v"])  # lines repeat in the table
        part = part.select("root", "path", "kind", F.col("fields")["v"].alias("v"))
        all_ = part if all_ is None else all_.unionByName(part)
    all_ = written(all_, "nodes").select("root", "path", "kind", F.map_from_arrays(F.array(F.lit("v")), F.array("v")).alias("fields"))  # both pulls are parts of it
    number = F.col("root").cast("long")
    table = Table(spark, f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", trees.NODE, "root", 16)
    first = trees.upsert(table, all_.where(number % 3 != 0))
    more = F.when((F.col("kind") == "entry") & (number % 10 == 0), F.map_from_arrays(F.array(F.lit("v")), F.array(F.concat(F.col("fields")["v"], F.lit("0"))))).otherwise(F.col("fields"))
    second = all_.where(number % 2 == 0).withColumn("fields", more)
    root = F.col("batch_id").cast("string").alias("root")
    gone = batches.where("batch_id % 7 = 0").select(root, F.col("batch_id").cast("string").alias("path")).unionByName(entries.where("batch_id % 11 = 0 and line = 2").select(root, F.concat_ws("/", "batch_id", "line").alias("path")))
    last = trees.upsert(table, second, gone, first)
    actions = trees.compared(table.rows(first), second, gone).select("path", "action")
    return table.rows(last).select("path", "kind", F.col("fields")["v"].alias("v")).join(actions, "path")


# Folds of ordered events: an event's type is the verb.
VERBS = {"view": "confirm", "signup": "reject", "purchase": "correct", "error": "acknowledge", "click": "approve"}


def _fold_sql(legal: dict, verbs: dict, start: str, subjects: str = "SELECT DISTINCT user_id FROM events") -> str:
    """A fold by a recursive query: each step takes every subject's next event."""
    verb = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in verbs.items()) + " END"
    to = "CASE f.state || '/' || e.verb " + " ".join(f"WHEN '{s}/{v}' THEN '{t}'" for (s, v), t in legal.items()) + " END"
    return f"""WITH RECURSIVE e AS (SELECT user_id, {verb} verb, row_number() OVER (PARTITION BY user_id ORDER BY event_id, {verb}) n FROM events),
f AS (SELECT user_id, '{start}' state, 0 n, 0 moved, 0 refused FROM ({subjects}) UNION ALL SELECT f.user_id, coalesce({to}, f.state), f.n + 1, f.moved + CASE WHEN {to} IS NULL THEN 0 ELSE 1 END, f.refused + CASE WHEN {to} IS NULL THEN 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, state, moved n_moved, refused n_refused FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"""


def _verbs(spark, d, verbs: dict) -> DataFrame:
    table = F.create_map(*(F.lit(x) for kv in verbs.items() for x in kv))
    return A.table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.try_element_at(table, F.col("event_type")).alias("verb"))


FOLDS = {
    "x15_link_reviews": (E.LINKS, VERBS, "suggested"),
    "x15_candidate_reviews": (E.CANDIDATES, {"view": "merge", "signup": "edit", "purchase": "reject", "error": "ignore", "click": "approve"}, "pending_review"),
    "x15_draft_reviews": (E.DRAFTS, {"view": "edit", "signup": "edit", "purchase": "send", "error": "reject", "click": "approve"}, "draft"),
}
for _name, (_legal, _verbs_, _start) in FOLDS.items():

    @query(_name, _fold_sql(_legal, _verbs_, _start), False)
    def folded(spark, d, legal=_legal, verbs=_verbs_, start=_start):
        events = _verbs(spark, d, verbs)
        return E.fold(events.select("user_id").distinct().withColumn("state", F.lit(start)), events, "user_id", legal)


@query("x8_alert_reviews", _fold_sql({("open", "acknowledge"): "acknowledged", ("open", "dismiss"): "dismissed", ("acknowledged", "dismiss"): "dismissed"}, {"view": "acknowledge", "click": "dismiss", "signup": "x", "purchase": "x", "error": "x"}, "open").replace("SELECT user_id, state, moved n_moved, refused n_refused", "SELECT user_id AS alert_id, state AS status, refused n_refused"), False)
def x8(spark, d):
    from ..operators import alerts

    e = _verbs(spark, d, {"view": "acknowledge", "click": "dismiss", "signup": "x", "purchase": "x", "error": "x"})
    events = e.select(F.col("user_id").alias("alert_id"), "seq", "verb", F.lit("a reason").alias("reason"))
    return alerts.review(events.select("alert_id").distinct().withColumn("status", F.lit("open")), events)


WAYS = [("draft", "review"), ("review", "draft"), ("review", "done")]


@query("x16_workflow", """WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'review' WHEN 'signup' THEN 'draft' WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'other' END t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) n FROM events WHERE event_type <> 'error' OR event_id % 40 = 0),
f AS (SELECT DISTINCT user_id, 'draft' state, 'active' status, 0 n, 2 events FROM events UNION ALL SELECT f.user_id, CASE WHEN ok THEN t ELSE state END, CASE WHEN ok AND t = 'done' THEN 'completed' WHEN status = 'active' AND t IS NULL THEN 'cancelled' ELSE status END, n + 1, events + CASE WHEN ok AND t = 'done' THEN 3 WHEN ok THEN 2 WHEN status = 'active' AND t IS NULL THEN 2 ELSE 0 END
 FROM (SELECT f.user_id, state, status, f.n, events, t, status = 'active' AND coalesce(state || '>' || t IN ('draft>review', 'review>draft', 'review>done'), false) ok FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) f)
SELECT user_id AS instance, state, status, events n_events FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""", False)
def x16(spark, d):
    t = A.table(spark, d, "events")
    to = F.when(F.col("event_type") == "view", "review").when(F.col("event_type") == "signup", "draft").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "other")
    ev = t.where("event_type <> 'error' or event_id % 40 = 0").select(F.col("user_id").alias("instance"), F.col("event_id").alias("seq"), to.alias("to_state"))
    starts = t.select(F.col("user_id").alias("instance")).distinct().select("instance", F.lit(1).alias("definition"), F.lit("draft").alias("state"))
    ways = spark.createDataFrame([(1, *w) for w in WAYS], "definition int, from_state string, to_state string")
    return E.workflow(starts, ev, ways, ["done"])


@query("j32_legal_transitions", "WITH i AS (SELECT c_custkey instance, CASE c_custkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'review' ELSE 'done' END s FROM customer) SELECT instance, t AS to_state FROM i JOIN (VALUES ('draft', 'review'), ('review', 'draft'), ('review', 'done')) w(s, t) USING (s)", False)
def j32(spark, d):
    s = F.when(F.col("c_custkey") % 3 == 0, "draft").when(F.col("c_custkey") % 3 == 1, "review").otherwise("done")
    i = A.table(spark, d, "customer").select(F.col("c_custkey").alias("instance"), F.lit(1).alias("definition"), s.alias("current_state"))
    return E.legal_transitions(i, spark.createDataFrame([(1, *w) for w in WAYS], "definition int, from_state string, to_state string")).select("instance", "to_state")


@query("x10_sync_runs", """WITH c AS (SELECT o_custkey run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) seq, CAST(o_orderdate AS DATE) e, o_orderkey % 10 n, o_orderkey % 13 = 0 failed FROM orders), s AS (SELECT run, min(seq) stop FROM c WHERE failed GROUP BY 1),
g AS (SELECT c.run, max(e) cursor, sum(n)::BIGINT n_rows, count(*) n_chunks FROM c LEFT JOIN s USING (run) WHERE stop IS NULL OR seq < stop GROUP BY 1)
SELECT a.run, cursor, coalesce(n_rows, 0) n_rows, coalesce(n_chunks, 0) n_chunks, CASE WHEN NOT f THEN 'completed' WHEN n_chunks > 0 THEN 'partial' ELSE 'failed' END status FROM (SELECT run, bool_or(failed) f FROM c GROUP BY 1) a LEFT JOIN g USING (run)""", False)
def x10(spark, d):
    from pyspark.sql import Window as W

    seq = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    c = A.table(spark, d, "orders").select(F.col("o_custkey").alias("run"), seq.alias("seq"), F.to_date("o_orderdate").alias("period_end"), (F.col("o_orderkey") % 10).alias("n"), (F.col("o_orderkey") % 13 == 0).alias("failed"))
    return E.sync_run(c)


@query("x13_epoch_changes", "SELECT s_suppkey mailbox, CASE s_suppkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'same' ELSE 'needs_recovery' END state FROM supplier", False)
def x13(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("mailbox"), F.lit(7).alias("epoch"))
    stored = s.withColumn("epoch", F.when(F.col("mailbox") % 3 == 1, 7).when(F.col("mailbox") % 3 == 2, 6))
    return E.epoch_changes(stored, s)


@query("x11_guarded_cursors", """WITH RECURSIVE r AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) c, o_orderkey % 7 = 0 resync, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) n FROM orders),
f AS (SELECT DISTINCT key, CAST(NULL AS DATE) c, 0 n, 0 refused FROM r UNION ALL SELECT f.key, CASE WHEN f.c IS NULL OR r.c >= f.c OR resync THEN r.c ELSE f.c END, f.n + 1, f.refused + CASE WHEN f.c IS NULL OR r.c >= f.c OR resync THEN 0 ELSE 1 END FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, c AS cursor, refused n_refused FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""", False)
def x11_batch(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("cursor"), (F.col("o_orderkey") % 7 == 0).alias("resync"))
    return E.guarded_cursor(o)


@query("n2_normal_amounts", "SELECT bill_id, CASE bill_id % 3 WHEN 2 THEN '1.23456' ELSE '1234.56' END amount FROM bills")
def n2(spark, d):
    k = F.col("bill_id") % 3
    return A.bills(spark, d).select("bill_id", N.normalize_amount(F.when(k == 0, "1 234,56").when(k == 1, "1.234,56").otherwise("1,234.56")).alias("amount"))


@query("n4_equal_cents", "SELECT bill_id, bill_id % 2 = 0 AS same FROM bills")
def n4(spark, d):
    off = F.when(F.col("bill_id") % 2 == 0, F.lit(0.004)).otherwise(F.lit(0.006)).cast("decimal(20,4)")
    return A.bills(spark, d).select("bill_id", N.same_cent(F.col("amount"), F.col("amount") + off).alias("same"))


@query("n8_displayed_amounts", "SELECT bill_id, translate(format('{:,.2f}', amount::DOUBLE), ',.', ' ,') shown FROM bills")
def n8(spark, d):
    return A.bills(spark, d).select("bill_id", N.display_amount(F.col("amount")).alias("shown"))


@query("m2_generated_ids", """SELECT batch_id, line, part, 'gl-entry:' || left(sha256('{"batch_id":' || batch_id || ',"line":' || line || ',"part":' || part || '}'), 32) AS id FROM entries""")
def m2(spark, d):
    return A.entries(spark, d).select("batch_id", "line", "part", FP.generated_id("gl-entry", "batch_id", "line", "part").alias("id"))


@query("t31_proposal_fingerprints", """SELECT bill_id, sha256('{"amount": "' || amount || '", "project_id": ' || bill_id || '}') fingerprint FROM bills""")
def t31(spark, d):
    amount = F.concat(F.lit('"'), F.col("amount").cast("string"), F.lit('"'))
    return A.bills(spark, d).select("bill_id", FP.spaced(project_id=F.col("bill_id").cast("string"), amount=amount).alias("fingerprint"))


@query("d3_chunks", "SELECT bill_id, bill_date + 31 * k AS start, least(bill_date + 31 * k + 30, bill_date + 75) AS \"end\" FROM bills, (SELECT unnest([0, 1, 2]) k)")
def d3(spark, d):
    b = A.bills(spark, d).select("bill_id", F.explode(D.chunks(F.col("bill_date"), F.date_add("bill_date", 75))).alias("c"))
    return b.select("bill_id", "c.*")
