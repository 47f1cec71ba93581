"""Alerts on project results: rules, candidates, conditions, skip reasons and the life of an alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import margin
from .folds import by_table

MOST_RULES = 10_000
STATUSES, SEVERITIES = ("open", "acknowledged", "resolved", "dismissed"), ("critical", "warning", "info")


def candidates(rules: DataFrame, projects: DataFrame, life: DataFrame, month: DataFrame) -> DataFrame:
    """Rules with the projects they look at: by status where a rule names some, else the active ones for the active
    scopes; by activity in any currency in the month or ever where the scope asks for it. Rules are few and sent along."""
    seen = lambda df, c: df.select("project_id", (F.col("n_allocations") > 0).alias(f"_{c}"), F.col("currencies").alias(f"_{c}_c"))
    p = projects.select("project_id", "status").join(seen(life, "life"), "project_id", "left").join(seen(month, "month"), "project_id", "left")
    active = lambda c: F.coalesce(F.col(f"_{c}") | F.col(f"_{c}_c").contains(","), F.lit(False))
    status = F.when(F.col("statuses").isNotNull(), F.array_contains(F.split("statuses", ","), F.col("status"))).when(F.col("scope").startswith("active"), F.col("status") == "active").otherwise(True)
    activity = F.when(F.col("scope") == "active_with_month_activity", active("month")).when(F.col("scope") == "all_with_activity", active("life")).otherwise(True)
    if rules.count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: a rule is a hand-written row that meets every project")
    both = p.join(F.broadcast(rules), how="cross")
    return both.where(status & activity).select(*rules.columns, "project_id")


def evaluate(rules: DataFrame, projects: DataFrame, life: DataFrame, month: DataFrame, shares: DataFrame, today: str) -> DataFrame:
    """A row for each rule and candidate: evaluated amount or margin, threshold, met or the reason to skip.

    life and month are ledger.financials() up to today, of all time and of the month; shares(project_id, shared_in,
    shared_out) lowers the result where a rule's basis is management. A grace day holds for the monthly negative and the
    margin rule, before anything is summed; rules on a lifetime and on missing revenue have none.
    """
    take = lambda df, tag: df.select("project_id", *(F.col(c).alias(f"{tag}_{c}") for c in ("revenue", "cost", "result", "unclassified", "n_allocations", "quality")))
    rows = candidates(rules, projects, life, month).join(take(life, "l"), "project_id").join(take(month, "m"), "project_id").join(shares, "project_id", "left")
    lifetime, kind = F.col("type") == "lifetime_negative", F.col("type")
    of = lambda c: F.when(lifetime, F.col(f"l_{c}")).otherwise(F.col(f"m_{c}"))
    net = F.coalesce("shared_in", F.lit(0)) - F.coalesce("shared_out", F.lit(0))
    result = of("result") - F.when(F.col("basis") == "management", net).otherwise(0)
    idle = (F.col("m_cost") == 0) & (F.col("m_n_allocations") == 0) & (F.col("m_unclassified") == 0)
    day = int(today[8:10])
    skip = (
        F.when(kind.isin("month_negative", "margin_below") & (F.lit(day) < F.col("grace_day")), F.concat(F.lit("grace_day_active:"), "grace_day"))
        .when(of("quality") == "mixed_currency", "skipped_mixed_currency")
        .when((kind == "month_no_revenue") & idle, "skipped_no_current_month_activity")
        .when((kind != "month_no_revenue") & (of("quality") == "no_data"), "skipped_no_data")
        .when((kind == "margin_below") & (F.col("m_revenue") <= 0), "skipped_margin_revenue_not_positive")
    )
    value = F.when(kind == "month_no_revenue", F.col("m_revenue").cast("double")).when(kind == "margin_below", F.when(F.col("m_revenue") > 0, margin(result, F.col("m_revenue")))).otherwise(result.cast("double"))
    threshold = F.when(kind == "margin_below", F.col("threshold_percent")).otherwise(F.col("threshold"))
    rows = rows.select("rule_id", "project_id", "type", "basis", skip.alias("skipped"), value.alias("_v"), threshold.alias("threshold"))
    met = F.when(kind == "month_no_revenue", F.col("_v") == 0).otherwise(F.col("_v") < F.col("threshold"))
    free = F.col("skipped").isNull()
    return rows.select("rule_id", "project_id", "type", "basis", "skipped", F.when(free, F.col("_v")).alias("evaluated"), "threshold", F.when(free, met).alias("met"))


def fingerprint(organization, period, version: int = 1):
    """sha256 of the compact JSON of seven keys in order."""
    keys = F.struct(F.col("type").alias("alert_type"), "basis", F.lit(version).alias("fingerprint_version"), organization.alias("organization_id"), period.alias("period_key"), "project_id", F.concat(F.lit("rule:"), "rule_id").alias("rule_identity"))
    return F.sha2(F.to_json(keys), 256)


def transition(previous: DataFrame, current: DataFrame) -> DataFrame:
    """previous(rule_id, project_id, status) and evaluate()'s rows -> what happens to each alert and its new status."""
    both = current.withColumn("_now", F.lit(True)).join(previous, ["rule_id", "project_id"], "full_outer")
    met, was = F.coalesce("met", F.lit(False)), F.col("status")
    action = (
        F.when(F.col("_now").isNull(), "unchanged")
        .when(F.col("skipped").isNotNull(), "skipped")
        .when(met & was.isNull(), "opened")
        .when(met & (was == "resolved"), "reopened")
        .when(met & (was == "dismissed"), "unchanged")
        .when(met, "updated")
        .when(was.isin("open", "acknowledged"), "resolved")
        .otherwise("unchanged")
    )
    status = F.when(action.isin("opened", "reopened"), "open").when(action == "resolved", "resolved").otherwise(was)
    return both.select("rule_id", "project_id", action.alias("action"), status.alias("status"))


def review(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """events(alert_id, seq, verb, reason) folded in order onto alerts(alert_id, status): an open alert may be acknowledged,
    an open or acknowledged one dismissed, with a reason; other events are refused and counted."""
    given = F.trim(F.coalesce("reason", F.lit(""))) != ""
    verbs = events.select("alert_id", "seq", F.when((F.col("verb") != "dismiss") | given, F.col("verb")).alias("verb"))
    legal = {("open", "acknowledge"): "acknowledged", ("open", "dismiss"): "dismissed", ("acknowledged", "dismiss"): "dismissed"}
    done = by_table(alerts, verbs, "alert_id", legal, "status")
    return done.select("alert_id", F.col("state").alias("status"), "n_refused")


def rank(column: str, values):
    out = F.lit(len(values) - 1)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Live alerts of each project and the rank of the severest (0 is the highest)."""
    return alerts.where(F.col("status").isin("open", "acknowledged")).groupBy("project_id").agg(F.count("*").alias("n"), F.min(rank("severity", SEVERITIES)).alias("highest"))


def summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES))


def first_page(alerts: DataFrame, size: int) -> DataFrame:
    order = [rank("status", STATUSES), rank("severity", SEVERITIES), F.col("project_id"), F.col("rule_id")]
    page = alerts.orderBy(*order).limit(size)
    return page.select("rule_id", "project_id", "severity", "status", F.row_number().over(W.orderBy(*order)).alias("position"))


def run_summary(moves: DataFrame) -> DataFrame:
    names = ("opened", "updated", "reopened", "resolved", "unchanged", "skipped")
    return moves.agg(F.count("*").alias("n"), *(F.count_if(F.col("action") == a).alias(f"n_{a}") for a in names), F.lit("completed").alias("status"))
