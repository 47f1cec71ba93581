"""Ledger queries: project results, months, verification, dashboards and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import alerts, ledger
from ..sources import adapters as A
from ..sources.shared import written
from .registry import doubles, query

START, END = "1993-01-15", "1997-11-20"


def chart(spark) -> DataFrame:
    return A.classification(spark)


def project_results(spark, d, start=START, end=END, currency=None) -> DataFrame:
    return ledger.financials(A.allocations(spark, d), A.projects(spark, d), chart(spark), start, end, currency)


def results_sql(start: str = START, end: str = END, currency: str | None = None, name: str = "results") -> str:
    """ledger.financials() for DuckDB, as further tables named after `name`."""
    counts = f"currency = '{currency}'" if currency else "held = 1"
    mixed = "false" if currency else "coalesce(len(currencies) > 1, false)"
    own = f"'{currency}'" if currency else "CASE WHEN len(currencies) = 1 THEN currencies[1] ELSE '' END"
    bucket = lambda b: f"sum(CASE WHEN {counts} AND bucket = '{b}' THEN normalized ELSE 0 END)"
    return f"""
{name}_in AS (SELECT *, CASE WHEN count(DISTINCT nullif(currency, '')) OVER (PARTITION BY project_id) <= 1 THEN 1 ELSE 0 END held
 FROM routed WHERE batch_date BETWEEN DATE '{start}' AND DATE '{end}'),
{name}_sum AS (SELECT project_id, {", ".join(f"{bucket(b)} {b}" for b in ledger.BUCKETS)}, count(*) FILTER (WHERE {counts}) n_allocations,
 count(*) FILTER (WHERE {counts} AND bucket = 'unclassified') n_unclassified, count(DISTINCT CASE WHEN {counts} THEN (batch_id, line, part, account_code) END) n_entries,
 count(DISTINCT CASE WHEN {counts} THEN batch_id END) n_batches, list_sort(list(DISTINCT currency) FILTER (WHERE currency <> '')) currencies,
 list_sort(list(DISTINCT sync_run_id) FILTER (WHERE {counts} AND sync_run_id IS NOT NULL)) runs FROM {name}_in GROUP BY project_id),
{name}_undated AS (SELECT project_id, count(*) n FROM star WHERE batch_date IS NULL GROUP BY 1),
{name}_code AS (SELECT organization_id, dimension_code, count(*) n FROM allocations WHERE project_id IS NULL AND batch_date BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY 1, 2),
{name} AS (SELECT p.project_id, {", ".join(f"coalesce({b}, 0) {b}" for b in ledger.BUCKETS)}, coalesce(revenue + cost, 0) classified, coalesce(revenue - cost, 0) AS result,
 CASE WHEN revenue <> 0 THEN round_even(CAST(revenue - cost AS DOUBLE) / CAST(revenue AS DOUBLE) * 100, 2) END margin, coalesce(n_allocations, 0) n_allocations,
 coalesce(n_unclassified, 0) n_unclassified, coalesce(n_entries, 0) n_entries, coalesce(n_batches, 0) n_batches, {own if currency else f"coalesce({own}, '')"} currency,
 coalesce(array_to_string(currencies, ','), '') currencies, coalesce(array_to_string(runs, ','), '') runs,
 concat_ws(',', CASE WHEN u.n > 0 THEN 'missing_batch_date:' || u.n END, CASE WHEN c.n > 0 THEN 'dimension_code_matches_project_without_project_fk:' || c.n END,
  CASE WHEN {mixed} THEN 'mixed_currency' END, CASE WHEN coalesce(unclassified, 0) <> 0 THEN 'unclassified_amount_present' END) warnings,
 CASE WHEN {mixed} THEN 'mixed_currency' WHEN coalesce(n_allocations, 0) = 0 THEN 'no_data' WHEN unclassified <> 0 THEN 'unclassified' ELSE 'complete' END quality
 FROM projects p LEFT JOIN {name}_sum s ON s.project_id = p.project_id LEFT JOIN {name}_undated u ON u.project_id = p.project_id
 LEFT JOIN {name}_code c ON c.organization_id = p.organization_id AND c.dimension_code = p.code)"""


MONEY = "revenue cost unclassified excluded classified result".split()
FLAT = ", ".join(f"CAST({c} AS DOUBLE) {c}" if c != "result" else "CAST(result AS DOUBLE) AS result" for c in MONEY)
REST = "project_id, margin, n_allocations, n_unclassified, n_entries, n_batches, currency, currencies, runs, warnings, quality"


@query("a1_project_financials", f", {results_sql()} SELECT {FLAT}, {REST} FROM results")
def a1(spark, d):
    return doubles(project_results(spark, d))


@query("p2_explicit_currency", f", {results_sql(currency='USD')} SELECT {FLAT}, {REST} FROM results")
def p2(spark, d):
    return doubles(project_results(spark, d, currency="USD"))


KINDS = [*ledger.DIRECT, "overhead"]


@query(
    "a2_month_series",
    f""", {results_sql()},
found AS (SELECT project_id, date_trunc('month', batch_date)::DATE m, {", ".join(f"sum(CASE WHEN bucket = '{b}' THEN normalized ELSE 0 END) {b}" for b in ledger.BUCKETS)},
 {", ".join(f"sum(CASE WHEN category = '{k}' THEN normalized ELSE 0 END) {k}" for k in KINDS)}, count(*) n, count(*) FILTER (WHERE bucket = 'unclassified') u
 FROM results_in WHERE held = 1 GROUP BY 1, 2),
spine AS (SELECT project_id, m::DATE m FROM projects, (SELECT unnest(generate_series(DATE '1993-01-01', DATE '1997-11-01', INTERVAL 1 MONTH)) m))
SELECT s.project_id, s.m AS month, greatest(s.m, DATE '{START}') AS start, least(last_day(s.m), DATE '{END}') AS "end",
 {", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) {c}" for c in ["revenue", *KINDS, "cost", "unclassified", "excluded"])}, CAST(coalesce(revenue - cost, 0) AS DOUBLE) AS result,
 CAST(coalesce(revenue + cost, 0) AS DOUBLE) classified, CASE WHEN revenue <> 0 THEN round_even(CAST(revenue - cost AS DOUBLE) / CAST(revenue AS DOUBLE) * 100, 2) END margin,
 coalesce(n, 0) n_allocations, coalesce(u, 0) n_unclassified FROM spine s LEFT JOIN found f ON f.project_id = s.project_id AND f.m = s.m""",
)
def a2(spark, d):
    return doubles(ledger.month_series(A.allocations(spark, d), A.projects(spark, d), chart(spark), START, END))


@query(
    "a4_category_totals",
    """SELECT category, CAST(sum(normalized) AS DOUBLE) total, count(*) n_allocations, count(DISTINCT (batch_id, line, part, account_code)) n_entries,
 array_to_string(list_sort(list(DISTINCT account_code)), ',') accounts FROM routed GROUP BY category""",
)
def a4(spark, d):
    own = ledger.base(A.allocations(spark, d), A.projects(spark, d))
    return doubles(ledger.category_totals(ledger.by_class(own, chart(spark))))


CHECKS = "SELECT (SELECT count(*) FROM entries) n_entries, (SELECT CAST(sum(greatest(amount, 0)) AS DOUBLE) FROM entries) debit, (SELECT CAST(sum(greatest(-amount, 0)) AS DOUBLE) FROM entries) credit"


@query(
    "a11_verification",
    f""", c AS ({CHECKS}), x AS (SELECT count(*) n_batches, min(batch_date) first_date, max(batch_date) last_date, count(*) FILTER (WHERE batch_date IS NULL) n_without_date,
 count(*) FILTER (WHERE batch_id NOT IN (SELECT batch_id FROM entries)) n_empty_batches, count(*) FILTER (WHERE organization_id <> 1) n_foreign_batches, count(DISTINCT nullif(currency, '')) n_currencies FROM batches),
y AS (SELECT count(DISTINCT (batch_id, line, part)) n_covered, count(*) n_allocations, count(a.project_id) n_linked, CAST(sum(amount) AS DOUBLE) allocated, count(*) FILTER (WHERE amount = 0) n_zero_allocations,
 count(*) FILTER (WHERE dimension_code = '') n_blank_codes, count(*) FILTER (WHERE p.organization_id <> a.organization_id) n_foreign_projects FROM allocations a LEFT JOIN projects p ON p.project_id = a.project_id)
SELECT c.*, x.*, y.*, debit - credit balance, (SELECT count(*) FROM entries WHERE amount = 0) n_zero_entries, (SELECT count(*) FROM entries WHERE account_code = '') n_without_account,
 (SELECT count(*) FROM entries WHERE batch_id NOT IN (SELECT batch_id FROM batches)) n_orphans, round_even(n_covered::DOUBLE / n_entries * 100, 2) coverage, round_even(n_linked::DOUBLE / n_allocations * 100, 2) link_percent FROM c, x, y""",
)
def a11(spark, d):
    return doubles(ledger.verify(A.entries(spark, d), A.batches(spark, d), A.allocations(spark, d), A.projects(spark, d), 1))


@query("a12_duplicate_identities", "SELECT count(*) n_keys, coalesce(sum(n), 0)::BIGINT n_rows FROM (SELECT batch_id, line, count(*) n FROM entries GROUP BY 1, 2 HAVING count(*) > 1)")
def a12(spark, d):
    return ledger.duplicate_keys(A.entries(spark, d), "batch_id", "line")


@query(
    "a14_account_rows",
    """SELECT account_code, count(*) n_entries, CAST(sum(greatest(amount, 0)) AS DOUBLE) debit, CAST(sum(greatest(-amount, 0)) AS DOUBLE) credit, min(batch_date) first_date, max(batch_date) last_date,
 count(project_id) n_linked, CAST(sum(CASE WHEN project_id IS NOT NULL THEN amount ELSE 0 END) AS DOUBLE) linked_total,
 array_to_string(list_sort(list(DISTINCT currency) FILTER (WHERE currency <> '')), ',') currencies FROM allocations GROUP BY account_code""",
)
def a14(spark, d):
    return doubles(ledger.account_rows(A.allocations(spark, d)))


@query(
    "j3_dimension_lookup",
    "SELECT batch_id, line, part, coalesce(a.project_id, p.project_id) project_id FROM allocations a LEFT JOIN projects p ON p.code = a.dimension_code AND p.organization_id = a.organization_id",
)
def j3(spark, d):
    return ledger.back_link(A.allocations(spark, d), A.projects(spark, d)).select("batch_id", "line", "part", "project_id")


MONTH = ("1995-03-01", "1995-03-31")
ACTIVE = "(revenue <> 0 OR cost <> 0 OR result <> 0 OR unclassified <> 0 OR n_allocations > 0)"


def dashboard(spark, d) -> DataFrame:
    rows = project_results(spark, d, *MONTH).where(ACTIVE)
    return rows.join(A.projects(spark, d), "project_id").withColumn("shown_margin", F.coalesce("margin", F.lit(-999999999.0)))


#: Sort key -> its columns; ties by code and id, and a falling order turns all of them round.
SORTS = {
    "code": ["code"],
    "name": ["name", "code"],
    "status": ["status", "code"],
    "revenue": ["revenue", "code"],
    "cost": ["cost", "code"],
    "result": ["result", "code"],
    "margin": ["shown_margin", "code"],
    "unclassified": ["unclassified", "code"],
    "allocations": ["n_allocations", "code"],
    "quality": ["quality", "code"],
}
BOARD = f", {results_sql(*MONTH)}, board AS (SELECT p.code, p.name, p.status, r.*, coalesce(margin, -999999999) shown_margin FROM results r JOIN projects p ON p.project_id = r.project_id WHERE {ACTIVE})"
PAGE = "code, name, status, CAST(revenue AS DOUBLE) revenue, CAST(cost AS DOUBLE) cost, CAST(result AS DOUBLE) AS result, margin"


def page(rows: DataFrame, sort: str, falling: bool, size: int = 25) -> DataFrame:
    """One page in order; only the page itself is numbered in one task."""
    order = [F.desc(c) if falling else F.asc(c) for c in (*SORTS[sort], "project_id")]
    return rows.orderBy(*order).limit(size).withColumn("position", F.row_number().over(W.orderBy(*order)))


def _page_query(sort: str, falling: bool, name: str):
    order = ", ".join(f"{c} {'DESC' if falling else 'ASC'}" for c in (*SORTS[sort], "project_id"))

    @query(name, f"{BOARD} SELECT {PAGE}, row_number() OVER (ORDER BY {order}) AS position FROM board ORDER BY position LIMIT 25")
    def run(spark, d):
        """A page of 25 rows is the feature; every project is aggregated."""
        return doubles(page(dashboard(spark, d), sort, falling).select("code", "name", "status", "revenue", "cost", "result", "margin", "position"))


_page_query("margin", True, "a15_dashboard_rows")
for _sort in SORTS:
    _page_query(_sort, _sort in ("revenue", "cost", "result"), f"o1_dashboard_by_{_sort}")


@query(
    "a16_totals_by_currency",
    f", {results_sql()} SELECT coalesce(nullif(currency, ''), 'unknown') currency, count(*) n_projects, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in ('revenue', 'cost', 'result', 'unclassified'))} FROM results GROUP BY 1",
)
def a16(spark, d):
    return doubles(ledger.totals_by_currency(project_results(spark, d)))


@query(
    "a17_summary_cards",
    f""", {results_sql()} SELECT count(*) n_projects, count(*) FILTER (WHERE result > 0) n_profit, count(*) FILTER (WHERE result < 0) n_loss, count(*) FILTER (WHERE result = 0) n_even,
 count(*) FILTER (WHERE unclassified <> 0) n_unclassified, {", ".join(f"CAST(CASE WHEN count(DISTINCT nullif(currency, '')) <= 1 THEN sum({c}) END AS DOUBLE) AS {c}" for c in ("revenue", "cost", "result"))} FROM results""",
)
def a17(spark, d):
    return doubles(ledger.summary_cards(project_results(spark, d)))


@query(
    "a18_unclassified_accounts",
    """SELECT account_code, count(*) n, CAST(sum(amount) AS DOUBLE) total, coalesce(array_to_string(list_sort(list(DISTINCT strftime(batch_date, '%Y-%m')) FILTER (WHERE batch_date IS NOT NULL)), ','), '') AS months
 FROM routed WHERE category = 'unclassified' GROUP BY account_code""",
)
def a18(spark, d):
    return doubles(ledger.unclassified_accounts(ledger.base(A.allocations(spark, d), A.projects(spark, d)), chart(spark)))


@query(
    "a26_lifetime_start",
    """SELECT p.project_id, coalesce(min(b.batch_date), CASE WHEN p.project_id % 2 = 0 THEN DATE '1994-05-01' END, CASE WHEN p.project_id % 3 = 0 THEN DATE '1993-02-02' END, DATE '2026-01-01') AS start
 FROM projects p LEFT JOIN batches b ON b.project_id = p.project_id GROUP BY p.project_id""",
)
def a26(spark, d):
    k = F.col("project_id")
    p = A.projects(spark, d).withColumn("start_date", F.when(k % 2 == 0, ledger.day("1994-05-01"))).withColumn("created", F.when(k % 3 == 0, ledger.day("1993-02-02")))
    return ledger.lifetime_start(p, A.batches(spark, d), "2026-01-01")


for _by, _order in (("count", "n DESC"), ("amount", "abs(amount) DESC")):

    @query(
        f"o5_unlinked_by_{_by}",
        f"SELECT dimension_code, count(*) n, CAST(sum(amount) AS DOUBLE) amount FROM allocations WHERE project_id IS NULL AND dimension_code <> '' GROUP BY 1 ORDER BY {_order.replace('amount', 'sum(allocations.amount)')}, 1 LIMIT 10",
    )
    def o5(spark, d, by=_by):
        """The ten codes are the feature."""
        return doubles(ledger.unlinked_codes(A.allocations(spark, d), by))


# Alerts: rule rows, each with its own type, basis, threshold, grace day, scope and statuses.
RULES = [
    (1, "lifetime_negative", "accounting", 0.0, None, None, "all_with_activity", None),
    (2, "month_negative", "accounting", 1000.0, None, None, "active_projects", None),
    (3, "month_negative", "management", 0.0, None, 20, "active_with_month_activity", None),
    (4, "month_no_revenue", "accounting", 0.0, None, 20, "active_projects", None),
    (5, "margin_below", "accounting", None, 40.0, None, "active_with_month_activity", "active,completed"),
    (6, "margin_below", "management", None, 10.0, 10, "all_with_activity", None),
]
RULE = "rule_id int, type string, basis string, threshold double, threshold_percent double, grace_day int, scope string, statuses string"
TODAY = "1995-03-18"
VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in RULES)
RULE_NAMES = ", ".join(x.split()[0] for x in RULE.split(", "))


def rules(spark) -> DataFrame:
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in (x.split() for x in RULE.split(', ')))} FROM VALUES {VALUES} AS t({RULE_NAMES})")


def shares(spark, d) -> DataFrame:
    """What projects get of shared cost and give away in the month: (project_id, shared_in, shared_out)."""
    return A.projects(spark, d).selectExpr("project_id", "CAST(project_id % 7 * 100 AS DECIMAL(20,6)) AS shared_in", "CAST(project_id % 3 * 50 AS DECIMAL(20,6)) AS shared_out")


def alert_facts(spark, d) -> DataFrame:
    a, p = A.allocations(spark, d), A.projects(spark, d)
    both = written(ledger.financials_of(a, p, chart(spark), [("1900-01-01", TODAY), (TODAY[:8] + "01", TODAY)]), "results")
    life, month = (both.where(F.col("period") == i).drop("period") for i in (0, 1))
    return alerts.evaluate(rules(spark), p, life, month, shares(spark, d), TODAY)


FACTS = f"""{results_sql("1900-01-01", TODAY, name="life")}, {results_sql(TODAY[:8] + "01", TODAY, name="mon")}, rules({RULE_NAMES}) AS (VALUES {VALUES}),
scoped AS (SELECT r.*, p.project_id, p.status FROM rules r JOIN projects p ON CASE WHEN statuses IS NOT NULL THEN list_contains(string_split(statuses, ','), p.status) WHEN scope LIKE 'active%' THEN p.status = 'active' ELSE true END
 JOIN life l ON l.project_id = p.project_id JOIN mon m ON m.project_id = p.project_id
 WHERE CASE scope WHEN 'active_with_month_activity' THEN m.n_seen > 0 WHEN 'all_with_activity' THEN l.n_seen > 0 ELSE true END),
facts AS (SELECT s.*, CASE WHEN type = 'lifetime_negative' THEN l.quality ELSE m.quality END quality, CASE WHEN type = 'lifetime_negative' THEN l.revenue ELSE m.revenue END revenue,
 CASE WHEN type = 'lifetime_negative' THEN l.result ELSE m.result END AS result, m.n_allocations, m.cost, m.unclassified, (project_id % 7 * 100)::DECIMAL(20,6) - (project_id % 3 * 50)::DECIMAL(20,6) AS net
 FROM scoped s JOIN life l USING (project_id) JOIN mon m USING (project_id)),
judged AS (SELECT rule_id, project_id, type, basis, CASE WHEN type IN ('month_negative', 'margin_below') AND grace_day > 18 THEN 'grace_day_active:' || grace_day
  WHEN quality = 'mixed_currency' THEN 'skipped_mixed_currency' WHEN type = 'month_no_revenue' AND cost = 0 AND n_allocations = 0 AND unclassified = 0 THEN 'skipped_no_current_month_activity'
  WHEN type <> 'month_no_revenue' AND quality = 'no_data' THEN 'skipped_no_data' WHEN type = 'margin_below' AND revenue <= 0 THEN 'skipped_margin_revenue_not_positive' END skipped,
 CASE type WHEN 'month_no_revenue' THEN revenue::DOUBLE WHEN 'margin_below' THEN CASE WHEN revenue > 0 THEN round_even(CAST(result - CASE WHEN basis = 'management' THEN net ELSE 0 END AS DOUBLE) / revenue::DOUBLE * 100, 2) END
  ELSE CAST(result - CASE WHEN basis = 'management' THEN net ELSE 0 END AS DOUBLE) END evaluated, CASE WHEN type = 'margin_below' THEN threshold_percent ELSE threshold END threshold FROM facts),
found AS (SELECT rule_id, project_id, type, basis, skipped, CASE WHEN skipped IS NULL THEN evaluated END evaluated, threshold,
 CASE WHEN skipped IS NULL THEN CASE WHEN type = 'month_no_revenue' THEN evaluated = 0 ELSE evaluated < threshold END END met FROM judged)"""
# n_seen: rows of the period in any currency
FACTS = FACTS.replace(" quality\n FROM projects p LEFT JOIN life_sum", " quality, coalesce((SELECT count(*) FROM life_in i WHERE i.project_id = p.project_id), 0) n_seen\n FROM projects p LEFT JOIN life_sum")
FACTS = FACTS.replace(" quality\n FROM projects p LEFT JOIN mon_sum", " quality, coalesce((SELECT count(*) FROM mon_in i WHERE i.project_id = p.project_id), 0) n_seen\n FROM projects p LEFT JOIN mon_sum")


@query("x5_alert_conditions", f", {FACTS} SELECT rule_id, project_id, type, basis, skipped, evaluated, CAST(threshold AS DOUBLE) threshold, met FROM found")
def x5(spark, d):
    return alert_facts(spark, d).select("rule_id", "project_id", "type", "basis", "skipped", "evaluated", "threshold", "met")


@query("x1_alert_candidates", f", {FACTS} SELECT rule_id, project_id FROM scoped")
def x1(spark, d):
    return alert_facts(spark, d).select("rule_id", "project_id")


STATUS = "CASE project_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'acknowledged' END"
PREVIOUS = f"previous AS (SELECT rule_id, project_id, status FROM (SELECT rule_id, project_id, {STATUS} status FROM rules, projects WHERE rule_id < 4) WHERE status IS NOT NULL)"
MOVES = """moves AS (SELECT coalesce(j.rule_id, p.rule_id) rule_id, coalesce(j.project_id, p.project_id) project_id, status was, CASE WHEN j.rule_id IS NULL THEN 'unchanged' WHEN skipped IS NOT NULL THEN 'skipped'
 WHEN met AND status IS NULL THEN 'opened' WHEN met AND status = 'resolved' THEN 'reopened' WHEN met AND status = 'dismissed' THEN 'unchanged' WHEN met THEN 'updated'
 WHEN status IN ('open', 'acknowledged') THEN 'resolved' ELSE 'unchanged' END AS action FROM found j FULL JOIN previous p ON j.project_id = p.project_id AND j.rule_id = p.rule_id)"""


def moves(spark, d) -> DataFrame:
    before = rules(spark).where("rule_id < 4").select("rule_id").join(A.projects(spark, d).select("project_id"), how="cross")  # three rules with every project
    return alerts.transition(before.withColumn("status", F.expr(STATUS)).where("status is not null"), alert_facts(spark, d))


@query("x7_alert_transitions", f", {FACTS}, {PREVIOUS}, {MOVES} SELECT rule_id, project_id, action, CASE WHEN action IN ('opened', 'reopened') THEN 'open' WHEN action = 'resolved' THEN 'resolved' ELSE was END status FROM moves")
def x7(spark, d):
    return moves(spark, d)


ACTIONS = ("opened", "updated", "reopened", "resolved", "unchanged", "skipped")


@query("x9_run_summary", f", {FACTS}, {PREVIOUS}, {MOVES} SELECT count(*) n, " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') n_{a}" for a in ACTIONS) + ", 'completed' AS status FROM moves")
def x9(spark, d):
    return alerts.run_summary(moves(spark, d))


@query(
    "t30_alert_fingerprints",
    f""", {FACTS} SELECT rule_id, project_id, sha256('{{"alert_type":"' || type || '","basis":"' || basis || '","fingerprint_version":1,"organization_id":1,"period_key":"1995-03","project_id":' || project_id || ',"rule_identity":"rule:' || rule_id || '"}}') AS fingerprint FROM found""",
)
def t30(spark, d):
    return alert_facts(spark, d).select("rule_id", "project_id", alerts.fingerprint(F.lit(1), F.lit("1995-03")).alias("fingerprint"))


SEVERITY = "CASE rule_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END"


def alert_rows(spark, d) -> DataFrame:
    return moves(spark, d).where("status is not null").withColumn("severity", F.expr(SEVERITY))


ALERTS = f""", {FACTS}, {PREVIOUS}, {MOVES}, alerts AS (SELECT * FROM (SELECT rule_id, project_id, {SEVERITY} severity,
 CASE WHEN action IN ('opened', 'reopened') THEN 'open' WHEN action = 'resolved' THEN 'resolved' ELSE was END status FROM moves) WHERE status IS NOT NULL)"""


@query("a19_severity_counts", f"{ALERTS} SELECT project_id, count(*) n, min(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) highest FROM alerts WHERE status IN ('open', 'acknowledged') GROUP BY 1")
def a19(spark, d):
    return alerts.severity_counts(alert_rows(spark, d))


@query(
    "a20_alert_summary",
    f"{ALERTS} SELECT count(*) n, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') n_{s}" for s in alerts.STATUSES) + ", " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') n_{s}" for s in alerts.SEVERITIES) + " FROM alerts",
)
def a20(spark, d):
    return alerts.summary(alert_rows(spark, d))


@query(
    "o2_alert_order",
    f"""{ALERTS} SELECT rule_id, project_id, severity, status, row_number() OVER (ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'acknowledged' THEN 1 WHEN 'resolved' THEN 2 ELSE 3 END,
 CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, project_id, rule_id) AS position FROM alerts ORDER BY position LIMIT 50""",
)
def o2(spark, d):
    """A page of 50 alerts is the feature."""
    return alerts.first_page(alert_rows(spark, d), 50)
