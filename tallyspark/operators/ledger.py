"""The general ledger: classification, routing, project and month financials, verification.

Allocations are rows of (batch_id, line, part, account_code, amount, organization_id, integration_id, batch_date, currency,
project_id or null, dimension_code, sync_run_id); the run is the one that brought the batch. Sums are partial before the chart of accounts is joined: a project, batch and account
give one row each, and only these are classified.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.dates import months_between_dates
from ..functions.numeric import margin

DIRECT = ["material_cost", "subcontractor_cost", "labor_cost", "equipment_cost", "transport_cost", "other_direct_cost"]
BUCKETS = ("revenue", "cost", "unclassified", "excluded")
#: Charts of accounts up to so many rows are sent to all tasks; larger ones are joined by their keys.
SMALL = 200_000
BATCH = ["organization_id", "integration_id", "currency", "account_code", "batch_id", "sync_run_id"]


def zero():
    return F.lit(0).cast("decimal(20,6)")


def day(x):
    return F.lit(x).cast("date")


def base(allocations: DataFrame, projects: DataFrame) -> DataFrame:
    """Allocations of a project whose organization is the batch's own; others are no one's."""
    return allocations.join(projects.select("project_id", F.col("organization_id").alias("_o")), "project_id").where("organization_id = _o").drop("_o")


def classify(rows: DataFrame, classification: DataFrame) -> DataFrame:
    """The account's active row of the integration, else the organization's own, else unclassified.

    The chart becomes one row an account, with a map of integrations, so one join finds both. It is sent to all tasks
    only up to SMALL rows, which are counted first.
    """
    item = F.struct(F.coalesce("integration_id", F.lit(0)).alias("k"), F.struct("category", "sign", "included").alias("v"))
    chart = classification.where("is_active").groupBy("organization_id", "account_code").agg(F.map_from_entries(F.collect_list(item)).alias("_m"))
    if classification.count() <= SMALL:
        chart = F.broadcast(chart)
    found = F.coalesce(F.try_element_at("_m", "integration_id"), F.try_element_at("_m", F.lit(0)))
    both = rows.join(chart, ["organization_id", "account_code"], "left").withColumn("_f", found)
    pick = lambda c, other: F.coalesce(f"_f.{c}", F.lit(other)).alias(c)
    return both.select(*rows.columns, pick("category", "unclassified"), pick("sign", 1), pick("included", True))


def route(rows: DataFrame, with_overhead: bool = True) -> DataFrame:
    """normalized = amount * sign, and the bucket it goes to."""
    costs, c = [*DIRECT, *(["overhead"] if with_overhead else [])], F.col("category")
    bucket = (
        F.when(c == "unclassified", "unclassified")
        .when((c == "excluded") | ~F.col("included"), "excluded")
        .when(c == "revenue", "revenue")
        .when(c.isin(costs), "cost")
        .otherwise("dropped")
    )
    return rows.withColumn("normalized", F.col("amount") * F.col("sign")).withColumn("bucket", bucket)


def by_account(allocations: DataFrame, classification: DataFrame, *keys: str, with_overhead: bool = True) -> DataFrame:
    """One classified and routed row for each key, batch and account: amount, n allocations and n entries."""
    keys = [k for k in keys if k not in BATCH]
    one = allocations.groupBy(*keys, *BATCH).agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.count_distinct("line", "part").alias("n_entries"))
    return route(classify(one, classification), with_overhead)


def first_of(keys: list[str], *of: str):
    """True for one row of each `of` within `keys`: from rows in order, so that no table of all entries is held."""
    own = F.struct(*of)
    return ~own.eqNullSafe(F.lag(own).over(W.partitionBy(*keys).orderBy(*of)))


def by_class(allocations: DataFrame, classification: DataFrame, with_overhead: bool = True) -> DataFrame:
    """by_account() summed over batches: one classified and routed row for each organization, integration and account."""
    keys, known = ["batch_id", *(k for k in BATCH if k != "batch_id")], F.col("line").isNotNull() & F.col("part").isNotNull()
    rows = allocations.select(*keys, "line", "part", "amount").withColumn("_new", first_of(keys, "line", "part") & known)
    one = rows.groupBy("organization_id", "integration_id", "account_code").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.count_if("_new").alias("n_entries"))
    return route(classify(one, classification), with_overhead)


def cells(rows: DataFrame, *keys: str, **more) -> DataFrame:
    """Sums of routed rows by key and currency: what a batch or account was is gone. Rows whose `dated` is false only count
    as such. A batch has one currency, so numbers of batches add up."""
    dated = F.col("dated")
    n = lambda c, when=dated: F.sum(F.when(when, F.col(c)).otherwise(0))
    return rows.groupBy(*keys, "currency").agg(
        *(F.sum(F.when(dated & (F.col("bucket") == b), F.col("normalized")).otherwise(zero())).alias(b) for b in BUCKETS),
        n("n").alias("n_allocations"),
        n("n", dated & (F.col("bucket") == "unclassified")).alias("n_unclassified"),
        n("n_entries").alias("n_entries"),
        n("n", ~dated).alias("n_undated"),
        F.count_distinct(F.when(dated, F.col("batch_id"))).alias("n_batches"),
        F.collect_set(F.when(dated, F.col("sync_run_id"))).alias("runs"),
        *(c.alias(k) for k, c in more.items()),
    )


def currency_rule(found: DataFrame, of: list[str], currency: str | None = None) -> DataFrame:
    """cells() with the currencies of each group, the one that holds for it, and whether the cell counts.

    An explicit currency leaves out all others, blank ones too. Else one currency keeps blank rows, and of a group with
    several no row counts (`counts` is false). A group has a cell for each currency (and month), which a window may hold.
    """
    named = F.when(F.col("n_allocations") > 0, F.nullif("currency", F.lit("")))
    found = found.withColumn("currencies", F.array_sort(F.collect_set(named).over(W.partitionBy(*of))))
    if currency:
        return found.withColumn("held", F.lit(currency)).withColumn("counts", F.col("currency") == currency)
    one = F.size("currencies") <= 1
    return found.withColumn("held", F.when(F.size("currencies") == 1, F.col("currencies")[0]).otherwise("")).withColumn("counts", one)


def totals(ruled: DataFrame, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the cells that count, result, margin, counts and warnings for each group."""
    counts = F.coalesce("counts", F.lit(False))
    n = lambda c: F.sum(F.when(counts, F.col(c)).otherwise(0)).alias(c)
    money = lambda c: F.sum(F.when(counts, F.col(c)).otherwise(zero())).alias(c)
    g = ruled.groupBy(*keys).agg(
        *(money(b) for b in (*BUCKETS, *more)),
        *(n(c) for c in ("n_allocations", "n_unclassified", "n_entries", "n_batches")),
        F.sum("n_undated").alias("n_undated"),
        F.first("currencies").alias("currencies"),
        F.first("held").alias("currency"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(counts, F.col("runs")))))).alias("runs"),
    )
    g = g.withColumn("classified", F.col("revenue") + F.col("cost")).withColumn("result", F.col("revenue") - F.col("cost"))
    return g.withColumn("margin", margin(F.col("result"), F.col("revenue")))


def quality(mixed):
    return F.when(mixed, "mixed_currency").when(F.col("n_allocations") == 0, "no_data").when(F.col("unclassified") != 0, "unclassified").otherwise("complete")


def financials(allocations: DataFrame, projects: DataFrame, classification: DataFrame, start, end, currency: str | None = None, with_overhead: bool = True) -> DataFrame:
    """One row for every project: its result in a closed period, with warnings and a data quality status."""
    return financials_of(allocations, projects, classification, [(start, end)], currency, with_overhead).drop("period")


def financials_of(allocations: DataFrame, projects: DataFrame, classification: DataFrame, periods: list[tuple], currency: str | None = None, with_overhead: bool = True) -> DataFrame:
    """The same for several closed periods, which may overlap, in one pass: a row for every project and period, `period`
    being the period's place in the list. A row without a date belongs to each."""
    date = F.col("batch_date")
    own = [F.when(date.between(day(a), day(b)), F.lit(i)) for i, (a, b) in enumerate(periods)]
    in_periods = lambda rows, undated: rows.withColumn("period", F.explode(F.array_compact(F.array(*(F.when(date.isNull(), F.lit(i)).otherwise(c) if undated else c for i, c in enumerate(own))))))
    inside = reduce(or_, (c.isNotNull() for c in own))
    rows = in_periods(base(allocations, projects).where(inside | date.isNull()), True).withColumn("dated", date.isNotNull())
    one = by_account(rows, classification, "project_id", "period", "dated", with_overhead=with_overhead)
    found = totals(currency_rule(cells(one, "project_id", "period"), ["project_id", "period"], currency), "project_id", "period")
    by_code = in_periods(allocations.where(inside & F.col("project_id").isNull()), False).groupBy("organization_id", F.col("dimension_code").alias("code"), "period").agg(F.count("*").alias("n_by_code"))
    every = projects.withColumn("period", F.explode(F.array(*(F.lit(i) for i in range(len(periods))))))
    both = every.join(found, ["project_id", "period"], "left").join(by_code, ["organization_id", "code", "period"], "left")
    money, counts = (*BUCKETS, "classified", "result"), ("n_allocations", "n_unclassified", "n_entries", "n_batches", "n_undated", "n_by_code")
    both = both.select("project_id", "period", *(F.coalesce(c, zero()).alias(c) for c in money), "margin", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "currency", "currencies", "runs")
    mixed = F.coalesce(F.size("currencies") > 1, F.lit(False)) if not currency else F.lit(False)
    warnings = F.concat_ws(
        ",",
        F.when(F.col("n_undated") > 0, F.concat(F.lit("missing_batch_date:"), "n_undated")),
        F.when(F.col("n_by_code") > 0, F.concat(F.lit("dimension_code_matches_project_without_project_fk:"), "n_by_code")),
        F.when(mixed, "mixed_currency"),
        F.when(F.col("unclassified") != 0, "unclassified_amount_present"),
    )
    flat = lambda c: F.array_join(F.coalesce(c, F.array()), ",").alias(c)
    return both.select("project_id", "period", *money, "margin", *counts[:4], F.coalesce("currency", F.lit(currency or "")).alias("currency"), flat("currencies"), flat("runs"), warnings.alias("warnings"), quality(mixed).alias("quality"))


def month_series(allocations: DataFrame, projects: DataFrame, classification: DataFrame, start, end, currency: str | None = None, with_overhead: bool = True) -> DataFrame:
    """The same for each project and calendar month of the period, clipped to it; months without rows are zeros.

    Columns of cost categories count rows that the result leaves out too, and overhead only where it is asked for.
    """
    inside = base(allocations, projects).where(F.col("batch_date").between(day(start), day(end))).withColumn("month", F.to_date(F.trunc("batch_date", "MM")))
    rows = by_account(inside.withColumn("dated", F.lit(True)), classification, "project_id", "month", "dated", with_overhead=with_overhead)
    kinds = [*DIRECT, *(["overhead"] if with_overhead else [])]
    of = {k: F.sum(F.when(F.col("category") == k, F.col("normalized")).otherwise(zero())) for k in kinds}
    found = totals(currency_rule(cells(rows, "project_id", "month", **of), ["project_id"], currency), "project_id", "month", more=tuple(kinds))
    spine = projects.select("project_id", F.explode(months_between_dates(day(start), day(end))).alias("m")).select("project_id", "m.*")
    both = spine.join(found, ["project_id", "month"], "left")
    money = ["revenue", *kinds, "cost", "result", "classified", "unclassified", "excluded"]
    return both.select("project_id", "month", "start", "end", *(F.coalesce(c, zero()).alias(c) for c in money), "margin", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_allocations", "n_unclassified")))


def category_totals(routed: DataFrame) -> DataFrame:
    """Totals of each category from by_account() or by_class() rows."""
    return routed.groupBy("category").agg(
        F.sum("normalized").alias("total"), F.sum("n").alias("n_allocations"), F.sum("n_entries").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("account_code")), ",").alias("accounts")
    )


def account_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account_code").agg(
        F.count("*").alias("n_entries"),
        F.sum(F.greatest("amount", zero())).alias("debit"),
        F.sum(F.greatest(-F.col("amount"), zero())).alias("credit"),
        F.min("batch_date").alias("first_date"),
        F.max("batch_date").alias("last_date"),
        F.count_if(F.col("project_id").isNotNull()).alias("n_linked"),
        F.sum(F.when(F.col("project_id").isNotNull(), F.col("amount")).otherwise(zero())).alias("linked_total"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("currency", F.lit("")))), ",").alias("currencies"),
    )


def unclassified_accounts(allocations: DataFrame, classification: DataFrame) -> DataFrame:
    """Accounts without a class: allocations, their plain sum and the months they fall in."""
    dated = allocations.withColumn("month", F.date_format("batch_date", "yyyy-MM"))
    one = classify(dated.groupBy("organization_id", "integration_id", "account_code", "month").agg(F.sum("amount").alias("amount"), F.count("*").alias("n")), classification)
    return one.where("category = 'unclassified'").groupBy("account_code").agg(F.sum("n").alias("n"), F.sum("amount").alias("total"), F.array_join(F.array_sort(F.collect_set("month")), ",").alias("months"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """How many keys occur more than once, and in how many rows."""
    return rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"))


def percent(part, whole):
    """Half even to 2 places; 0 where there is nothing to take a share of."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part.cast("double") / whole * 100, 2))


def verify(entries: DataFrame, batches: DataFrame, allocations: DataFrame, projects: DataFrame, organization: int) -> DataFrame:
    """One row of checks of a whole ledger: counts, sums, links, organization, data quality and coverage."""
    count, filled = F.count_if, F.col("project_id").isNotNull()
    net = F.col("amount")
    per_batch = entries.groupBy("batch_id").agg(
        F.count("*").alias("e"), F.sum(F.greatest(net, zero())).alias("debit"), F.sum(F.greatest(-net, zero())).alias("credit"), count(net == 0).alias("e_zero"), count(F.col("account_code") == "").alias("e_no_account")
    )
    both = batches.join(per_batch, "batch_id", "full_outer").withColumn("known", F.col("organization_id").isNotNull())
    one = both.agg(
        count("known").alias("n_batches"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("n_entries"),
        F.sum("debit").alias("debit"),
        F.sum("credit").alias("credit"),
        F.coalesce(F.sum("e_zero"), F.lit(0)).alias("n_zero_entries"),
        F.coalesce(F.sum("e_no_account"), F.lit(0)).alias("n_without_account"),
        F.min("batch_date").alias("first_date"),
        F.max("batch_date").alias("last_date"),
        count(F.col("known") & F.col("batch_date").isNull()).alias("n_without_date"),
        count(F.col("known") & F.col("e").isNull()).alias("n_empty_batches"),
        F.sum(F.when(~F.col("known"), F.col("e")).otherwise(0)).alias("n_orphans"),
        count(F.col("known") & (F.col("organization_id") != organization)).alias("n_foreign_batches"),
        F.count_distinct(F.nullif("currency", F.lit(""))).alias("n_currencies"),
    )
    with_org = allocations.join(projects.select("project_id", F.col("organization_id").alias("_o")), "project_id", "left")
    narrow = with_org.select("batch_id", "line", "part", "amount", "dimension_code", filled.alias("_linked"), (F.col("_o") != F.col("organization_id")).alias("_foreign"))
    two = narrow.withColumn("_new", first_of(["batch_id"], "line", "part")).agg(
        count("_new").alias("n_covered"),
        F.count("*").alias("n_allocations"),
        count("_linked").alias("n_linked"),
        F.sum("amount").alias("allocated"),
        count(net == 0).alias("n_zero_allocations"),
        count(F.coalesce("dimension_code", F.lit("")) == "").alias("n_blank_codes"),
        count("_foreign").alias("n_foreign_projects"),
    )
    all_ = one.join(two, F.lit(True))  # two frames of one row
    all_ = all_.withColumn("balance", F.col("debit") - F.col("credit"))
    return all_.withColumn("coverage", percent(F.col("n_covered"), F.col("n_entries"))).withColumn("link_percent", percent(F.col("n_linked"), F.col("n_allocations")))


def unlinked_codes(allocations: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n codes of most unlinked allocations, or of the largest absolute amount; ties by code."""
    g = allocations.where("project_id is null and dimension_code <> ''").groupBy("dimension_code").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return g.orderBy(F.desc("n") if by == "count" else F.desc(F.abs("amount")), "dimension_code").limit(n)


def totals_by_currency(financials_: DataFrame) -> DataFrame:
    """Sums of projects' results for each currency that holds."""
    return financials_.groupBy(F.coalesce(F.nullif("currency", F.lit("")), F.lit("unknown")).alias("currency")).agg(
        F.count("*").alias("n_projects"), *(F.sum(c).alias(c) for c in ("revenue", "cost", "result", "unclassified"))
    )


def summary_cards(rows: DataFrame) -> DataFrame:
    """One row: projects, counts by sign of the result and missing class, and totals where there is one currency."""
    single = F.count_distinct(F.nullif("currency", F.lit(""))) <= 1
    return rows.agg(
        F.count("*").alias("n_projects"),
        F.count_if(F.col("result") > 0).alias("n_profit"),
        F.count_if(F.col("result") < 0).alias("n_loss"),
        F.count_if(F.col("result") == 0).alias("n_even"),
        F.count_if(F.col("unclassified") != 0).alias("n_unclassified"),
        *(F.when(single, F.sum(c)).alias(c) for c in ("revenue", "cost", "result")),
    )


def lifetime_start(projects: DataFrame, batches: DataFrame, today) -> DataFrame:
    """The first batch date, else the project's own start, else the day it was made, else today."""
    first = batches.groupBy("project_id").agg(F.min("batch_date").alias("first"))
    return projects.join(first, "project_id", "left").select("project_id", F.coalesce("first", "start_date", "created", day(today)).alias("start"))


def dimension_coverage(projects: DataFrame, dimensions: DataFrame) -> DataFrame:
    """code -> linked, missing (only in the ledger) or workspace_only."""
    p, d = projects.select("code", F.lit(True).alias("_p")), dimensions.select("code", F.lit(True).alias("_d"))
    both = p.join(d, "code", "full_outer")
    return both.select("code", F.when(F.col("_p") & F.col("_d"), "linked").when(F.col("_d"), "missing").otherwise("workspace_only").alias("state"))


def back_link(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows with a dimension code but no project take the project of that code in their organization."""
    p = projects.select(F.col("code").alias("dimension_code"), "organization_id", F.col("project_id").alias("_p"))
    return rows.join(p, ["dimension_code", "organization_id"], "left").withColumn("project_id", F.coalesce("project_id", "_p")).drop("_p")
