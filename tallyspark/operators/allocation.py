"""Allocation of shared cost: sources, weights, balanced rounding, edits, checks, versions and management results.

Shares are computed in whole cents: quotient and remainder of integers, so no decimal division rounds twice. Group totals
are grouped sums joined back, so a large group is summed in parts and its rows stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import margin


def money(x=0):
    return F.lit(x).cast("decimal(20,6)")


def with_totals(rows: DataFrame, group: str, **aggs) -> DataFrame:
    """rows with the group's aggregates as further columns."""
    return rows.join(rows.groupBy(group).agg(*(v.alias(k) for k, v in aggs.items())), group)


def revenue_weights(rows: DataFrame, group: str, revenue: str = "revenue") -> DataFrame:
    """weight = revenue over the group's positive revenue; zero and negative get 0 and a warning, no positive an error."""
    own = F.greatest(F.col(revenue), F.lit(0).cast("decimal(20,2)"))
    x = with_totals(rows, group, _total=F.sum(own))
    note = F.when(F.col("_total") <= 0, "error").when(F.col(revenue) == 0, "zero_revenue_project").when(F.col(revenue) < 0, "negative_revenue_project_excluded").otherwise("ok")
    return x.withColumn("weight", F.when(F.col("_total") > 0, own.cast("double") / F.col("_total").cast("double"))).withColumn("note", note).drop("_total")


def balanced(rows: DataFrame, group: str, source: str, part: str, order: list[str]) -> DataFrame:
    """amount: source * part / sum(part) in cents, half up; the group's last row by `order` takes the remainder.

    source is in cents and part a whole number, both long. Percents are of 4 places, half even, balanced the same way.
    """
    key = F.struct(*order)
    x = with_totals(rows, group, _t=F.sum(part), _end=F.max(key)).withColumn("_last", key == F.col("_end"))
    x = x.withColumn("_c", F.expr(f"(2 * abs({source}) * {part} + _t) div (2 * _t)") * F.signum(F.col(source)).cast("long"))
    x = x.withColumn("_q", F.expr(f"(1000000 * {part}) div _t")).withColumn("_r", F.expr(f"(1000000 * {part}) % _t"))
    up = (F.col("_r") * 2 > F.col("_t")) | ((F.col("_r") * 2 == F.col("_t")) & (F.col("_q") % 2 == 1))
    x = x.withColumn("_p", F.col("_q") + F.when(up, 1).otherwise(0))
    rest = F.when(~F.col("_last"), 1).otherwise(0)
    x = with_totals(x, group, _sc=F.sum(F.col("_c") * rest), _sp=F.sum(F.col("_p") * rest))
    cents = F.when(F.col("_last"), F.col(source) - F.col("_sc")).otherwise(F.col("_c"))
    percent = F.when(F.col("_last"), 1000000 - F.col("_sp")).otherwise(F.col("_p"))
    return x.select(*rows.columns, cents.alias("amount_cents"), percent.alias("percent_10000"))


def edited(rows: DataFrame, group: str, source: str, order: list[str], by: str) -> DataFrame:
    """A draft as edited: percents (1/10000) or amounts (cents) hold, the other follows, and the last row takes the rest of
    it. error where the held column doesn't total 100 or the source, or a percent is outside 0 and 100."""
    key = F.struct(*order)
    x = with_totals(rows, group, _sum=F.sum("percent_10000" if by == "percent" else "amount_cents"), _bad=F.max(~F.col("percent_10000").between(0, 1000000)), _end=F.max(key)).withColumn("_last", key == F.col("_end"))
    if by == "percent":
        error = F.when(F.col("_bad"), "percent_out_of_range").when((F.col("_sum") != 1000000) & (F.col(source) != 0), "percents_not_100")
        x = x.withColumn("_c", F.expr(f"(2 * abs({source}) * percent_10000 + 1000000) div 2000000") * F.signum(F.col(source)).cast("long"))
        x = with_totals(x, group, _all=F.sum("_c"))
        return x.select(*rows.columns, error.alias("error"), (F.col("_c") + F.when(F.col("_last"), F.col(source) - F.col("_all")).otherwise(0)).alias("new_cents"), F.col("percent_10000").alias("new_percent"))
    error = F.when(F.col("_sum") != F.col(source), "amounts_not_source")
    share = F.when(F.col(source) != 0, F.bround(F.col("amount_cents").cast("decimal(20,0)") * 1000000 / F.col(source).cast("decimal(20,0)"), 0).cast("long")).otherwise(0)
    x = with_totals(x.withColumn("_p", share), group, _all=F.sum("_p"))
    return x.select(*rows.columns, error.alias("error"), F.col("amount_cents").alias("new_cents"), (F.col("_p") + F.when(F.col("_last") & (F.col(source) != 0), 1000000 - F.col("_all")).otherwise(0)).alias("new_percent"))


def check_manual(rows: DataFrame, group: str, source: str) -> DataFrame:
    """What is wrong with hand-set percents (1/10000) and amounts (cents) of each group, or null."""
    g = rows.groupBy(group).agg(F.sum("percent_10000").alias("p"), F.min("percent_10000").alias("low"), F.sum("amount_cents").alias("a"), F.min("amount_cents").alias("least"), F.first(source).alias("s"))
    percent = F.when(F.col("low") < 0, "negative_percent").when(F.col("p") != 1000000, "percents_not_100")
    amount = F.when((F.col("s") >= 0) & (F.col("least") < 0), "negative_amount").when(F.col("a") != F.col("s"), "amounts_not_source")
    return g.select(group, percent.alias("percent_error"), amount.alias("amount_error"))


def check_balance(rows: DataFrame, group: str, source: str) -> DataFrame:
    """Per group: what amounts and percents sum to, and whether they are the source and 100."""
    g = rows.groupBy(group).agg(F.sum("amount_cents").alias("sum_cents"), F.first(source).alias("source_cents"), F.sum("percent_10000").alias("sum_percent"))
    return g.withColumn("balanced", (F.col("sum_cents") == F.col("source_cents")) & ((F.col("source_cents") == 0) | (F.col("sum_percent") == 1000000)))


def validate(versions: DataFrame, entries: DataFrame, projects: DataFrame) -> DataFrame:
    """(version_id, error): the first of a project twice, of another organization, the source itself as target, sums that
    don't balance; null where all is well. versions(version_id, organization_id, source_project_id, source)."""
    x = entries.join(versions.select("version_id", F.col("organization_id").alias("_org"), "source_project_id", "source"), "version_id").join(projects.select("project_id", "organization_id"), "project_id")
    one = x.groupBy("version_id", "project_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.max(F.col("organization_id") != F.col("_org")).alias("foreign_"), F.max(F.coalesce(F.col("project_id") == F.col("source_project_id"), F.lit(False))).alias("self"), F.first("source").alias("source"))
    g = one.groupBy("version_id").agg(F.max("n").alias("n"), F.sum("amount").alias("amount"), F.max("foreign_").alias("foreign_"), F.max("self").alias("self"), F.first("source").alias("source"))
    return errors(g)


def rule_validate(versions: DataFrame, targets: DataFrame, rule: Rule, projects: DataFrame) -> DataFrame:
    """validate() of a rule's entries: what all targets of an `on` have in common is found once."""
    own = targets.join(projects.select("project_id", "organization_id"), "project_id")
    copies = own.groupBy(rule.on, "project_id").agg(F.count("*").alias("_c"), F.min("organization_id").alias("_low"), F.max("organization_id").alias("_high"))
    group = copies.groupBy(rule.on).agg(F.max("_c").alias("_c"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    is_target = copies.select(rule.on, F.col("project_id").alias("source_project_id"), F.lit(True).alias("_self"))
    x = given(versions, own, rule).join(group, rule.on).join(is_target, [rule.on, "source_project_id"], "left")
    foreign = (F.col("_low") != F.col("organization_id")) | (F.col("_high") != F.col("organization_id"))
    g = x.groupBy("version_id").agg((F.max("_c") * F.count("*")).alias("n"), F.sum("amount").alias("amount"), F.max(foreign).alias("foreign_"), F.max(F.coalesce("_self", F.lit(False))).alias("self"), F.first("source").alias("source"))
    return errors(g)


def errors(g: DataFrame) -> DataFrame:
    error = F.when(F.col("n") > 1, "duplicate_project").when(F.col("foreign_"), "other_organization").when(F.col("self"), "source_is_target").when(F.col("amount") != F.col("source"), "amounts_not_source")
    return g.select("version_id", error.alias("error"))


def pool_amounts(entries: DataFrame, batches: DataFrame, pools: DataFrame, start, end) -> DataFrame:
    """(pool_id, amount, n): debit less credit of the accounts that pools(pool_id, organization_id, account_code, is_active) map."""
    b = batches.where(F.col("batch_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("batch_id", "organization_id")
    sums = entries.join(b, "batch_id").groupBy("organization_id", "account_code").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    found = pools.where("is_active").select("pool_id", "organization_id", "account_code").distinct().join(sums, ["organization_id", "account_code"])
    g = found.groupBy("pool_id").agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    return pools.select("pool_id").distinct().join(g, "pool_id", "left").select("pool_id", F.coalesce("amount", money()).alias("amount"), F.coalesce("n", F.lit(0)).alias("n"))


def source_amounts(versions: DataFrame, direct_cost: DataFrame, pools: DataFrame) -> DataFrame:
    """(version_id, amount, basis): what is set by hand, else the source project's direct cost, else the pool's accounts.

    versions(version_id, manual_amount, source_project_id, pool_id); direct_cost(project_id, cost, quality): a project of
    several currencies has none.
    """
    c = direct_cost.select(F.col("project_id").alias("source_project_id"), F.when(F.col("quality") != "mixed_currency", F.col("cost")).alias("_cost"))
    both = versions.join(c, "source_project_id", "left").join(pools.select("pool_id", F.col("amount").alias("_pool")), "pool_id", "left")
    basis = F.when(F.col("manual_amount").isNotNull(), "manual").when(F.col("source_project_id").isNotNull(), "project_direct_cost").otherwise("mapped_gl_accounts")
    amount = F.when(F.col("manual_amount").isNotNull(), F.col("manual_amount")).when(F.col("source_project_id").isNotNull(), F.col("_cost")).otherwise(F.coalesce("_pool", money()))
    return both.select("version_id", amount.alias("amount"), basis.alias("basis"))


def outside_scope(selected: DataFrame, parties: DataFrame) -> DataFrame:
    """Selected (manager, project_id) that the manager, by e-mail or else by name, is no active manager of."""
    key = F.coalesce(F.nullif("email", F.lit("")), F.col("name"))
    managed = parties.where("role = 'project_manager' and is_active").select(key.alias("manager"), "project_id").distinct()
    return selected.join(managed, ["manager", "project_id"], "left_anti")


def in_months(entries: DataFrame, versions: DataFrame, months: list[tuple[int, int]], status: str = "approved") -> DataFrame:
    """Entries of versions with that status in the listed months, with the version's columns."""
    return entries.join(of_status(versions, months, status), "version_id")


@dataclass(frozen=True)
class Rule:
    """Entries that follow from a rule: each version gives to each target (project_id, manual) of its `on` an amount that the
    columns `version` and `target`, their classes, fix. Rows of a class give equal entries, so sums are taken over pairs of
    classes and joined back to the rows; only what is asked for by version and project is expanded to entries."""

    on: str
    version: str
    target: str
    amount: str


#: Blocks that the targets of one `on` are dealt into where entries are expanded.
BLOCKS = 64
#: Versions of a run at most, and entries of a task, some.
RUN, ENTRIES = 256, 20_000_000


def of_status(versions: DataFrame, months: list[tuple[int, int]], status: str = "approved") -> DataFrame:
    wanted = F.concat(F.col("year"), F.lit("-"), F.col("month")).isin([f"{y}-{m}" for y, m in months])
    return versions.where((F.col("status") == status) & wanted)


def received(versions: DataFrame, targets: DataFrame, rule: Rule, *keys: str, **aggs) -> DataFrame:
    """(project_id, *keys, amount, **aggs) of what each target gets: sums of `amount` by columns of versions; aggs look at a
    class of versions, of which there are `_n`."""
    more = {c: f"_{c}" for c in ("year", "month", "pool_id") if c not in keys}
    named = versions.withColumns({v: F.col(k).isNotNull() if k == "pool_id" else F.col(k) for k, v in more.items()})
    of_versions = named.groupBy(rule.on, rule.version, *keys, *more.values()).agg(F.count("*").alias("_n"))
    of_targets = targets.select(rule.on, rule.target).distinct()
    sums = of_versions.join(of_targets, rule.on).groupBy(rule.on, rule.target, *keys).agg(F.sum(F.expr(rule.amount) * F.col("_n")).alias("amount"), *(c.alias(k) for k, c in aggs.items()))
    own = targets.groupBy("project_id", rule.on, rule.target).agg(F.count("*").alias("_copies"))
    return own.join(sums, [rule.on, rule.target]).select("project_id", *keys, (F.col("amount") * F.col("_copies")).alias("amount"), *aggs)


def given(versions: DataFrame, targets: DataFrame, rule: Rule) -> DataFrame:
    """versions that have targets, with the number (n) and sum (amount) of their entries."""
    of_targets = targets.groupBy(rule.on, rule.target).agg(F.count("*").alias("_n"))
    of_versions = versions.select(rule.on, rule.version).distinct()
    sums = of_versions.join(of_targets, rule.on).groupBy(rule.on, rule.version).agg(F.sum("_n").alias("n"), F.sum(F.expr(rule.amount) * F.col("_n")).alias("amount"))
    return versions.join(sums, [rule.on, rule.version])


def given_by_project(versions: DataFrame, targets: DataFrame, rule: Rule, *keys: str) -> DataFrame:
    """(project_id, *keys, n, amount) of what each source project gives away."""
    out = given(versions.where("source_project_id is not null"), targets, rule)
    return out.groupBy(F.col("source_project_id").alias("project_id"), *keys).agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def runs(versions: DataFrame, *alike: str) -> DataFrame:
    """(*alike, _rows): the rows of versions in lists of at most RUN rows that are alike in those columns; most lists are full."""
    rest = [c for c in versions.columns if c not in alike]
    x = with_totals(versions.withColumn("_h", F.xxhash64(*alike)), "_h", _n=F.count("*"))
    deal = F.pmod(F.xxhash64(*rest), F.ceil(F.col("_n") / (16 * RUN))).alias("_deal")
    lists = x.groupBy(*alike, deal).agg(F.collect_list(F.struct(*rest)).alias("_all"))
    starts = F.sequence(F.lit(1), F.size("_all"), F.lit(RUN))
    return lists.select(*alike, "_all", F.explode(starts).alias("_at")).select(*alike, F.slice("_all", F.col("_at"), RUN).alias("_rows"))


def expanded(versions: DataFrame, targets: DataFrame, rule: Rule, *alike: str, **columns) -> DataFrame:
    """An entry for each version and each target of its `on`, with `amount` or, instead, the given columns, which may name the
    columns of the target, the rule and `alike`.

    Targets are dealt into blocks, and a block of one `on` meets its versions in one task, so no task gets a whole group and no
    entry is shuffled. Versions come in runs that are alike: columns are computed once for a run and a target, and a run's
    versions repeat in the same order for target after target, so that entries written to files take few bytes. Entries are
    counted first: of many there are more tasks, not longer ones.
    """
    sizes = versions.groupBy(rule.on).agg(F.count("*").alias("_v")).join(targets.groupBy(rule.on).agg(F.count("*").alias("_t")), rule.on)
    n = max(8 * versions.sparkSession.sparkContext.defaultParallelism, (sizes.agg(F.sum(F.col("_v") * F.col("_t"))).first()[0] or 0) // ENTRIES)
    mine = runs(versions, rule.on, rule.version, *alike).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).repartition(n, rule.on, "_b")
    other = targets.withColumn("_b", F.pmod(F.xxhash64("project_id"), F.lit(BLOCKS)).cast("int")).repartition(n, rule.on, "_b")
    pairs = mine.join(other.hint("shuffle_hash"), [rule.on, "_b"]).withColumns(columns or {"amount": F.expr(rule.amount)})
    # coalesce moves nothing here: it ends the join's generated code, so a task holds one pair's entries, not those of all pairs of a run
    return pairs.drop("_b").coalesce(n).select("*", F.inline("_rows")).drop("_rows")


def rule_breakdown(versions: DataFrame, targets: DataFrame, rule: Rule, amount: str = "decimal(38,6)") -> DataFrame:
    """breakdown() of a rule's entries: a project's total comes from the classes, and its entries are written where they arise."""
    total = received(versions, targets, rule).withColumnRenamed("amount", "_total")
    own = targets.groupBy("project_id", rule.on, rule.target).agg(F.count("*").alias("_t"), F.bool_or("manual").alias("any_manual")).join(total, "project_id")
    each = versions.groupBy("version_id", rule.on, rule.version).agg(F.count("*").alias("_v"))
    given = F.expr(rule.amount) * F.col("_t") * F.col("_v")
    share = F.when(F.col("_total") != 0, F.bround(given.cast("double") / F.col("_total").cast("double") * 100, 2)).otherwise(0.0)
    return expanded(each, own, rule, "_v", amount=given.cast(amount), percent=share).select("project_id", "version_id", "amount", "any_manual", "percent")


def breakdown(rows: DataFrame, by: str = "project_id") -> DataFrame:
    """Amount and percent of the total for each version that a project receives (or, by its source, gives)."""
    g = rows.groupBy(by, "version_id").agg(F.sum("amount").alias("amount"), F.bool_or("manual").alias("any_manual"))
    x = with_totals(g, by, _total=F.sum("amount"))
    share = F.when(F.col("_total") != 0, F.bround(F.col("amount").cast("double") / F.col("_total").cast("double") * 100, 2)).otherwise(0.0)
    return x.select(by, "version_id", "amount", "any_manual", share.alias("percent"))


def management_result(results: DataFrame, entries: DataFrame, versions: DataFrame, months: list[tuple[int, int]]) -> DataFrame:
    """results: ledger.financials() -> with cost allocated in and out, the management result, margins and warnings."""
    inside = in_months(entries, versions, months).withColumn("_m", F.format_string("%04d-%02d", "year", "month"))
    got = inside.groupBy("project_id").agg(F.sum("amount").alias("shared_in"), F.array_sort(F.collect_set("_m")).alias("_have"), F.count("pool_id").alias("_pools"))
    gave = inside.where("source_project_id is not null").groupBy(F.col("source_project_id").alias("project_id")).agg(F.sum("amount").alias("shared_out"))
    drafts = in_months(entries, versions, months, "draft").where("pool_id is not null").select("project_id").distinct()
    return managed(results, got, gave, drafts, months)


def rule_management_result(results: DataFrame, versions: DataFrame, targets: DataFrame, rule: Rule, months: list[tuple[int, int]]) -> DataFrame:
    """management_result() of a rule's entries."""
    approved, drafts = of_status(versions, months), of_status(versions, months, "draft").where("pool_id is not null")
    have = F.array_sort(F.collect_set(F.format_string("%04d-%02d", "_year", "_month")))
    got = received(approved, targets, rule, _have=have, _pools=F.sum(F.when(F.col("_pool_id"), F.col("_n")).otherwise(0))).withColumnRenamed("amount", "shared_in")
    gave = given_by_project(approved, targets, rule).select("project_id", F.col("amount").alias("shared_out"))
    return managed(results, got, gave, received(drafts, targets, rule).select("project_id"), months)


def managed(results: DataFrame, got: DataFrame, gave: DataFrame, drafts: DataFrame, months: list[tuple[int, int]]) -> DataFrame:
    """results with got(project_id, shared_in, _have, _pools), gave(project_id, shared_out) and the projects of drafts."""
    drafts = drafts.withColumn("_draft", F.lit(True))
    both = results.join(got, "project_id", "left").join(gave, "project_id", "left").join(drafts, "project_id", "left")
    both = both.withColumn("shared_in", F.coalesce("shared_in", money())).withColumn("shared_out", F.coalesce("shared_out", money()))
    total = F.col("cost") + F.col("shared_in") - F.col("shared_out")
    lack = F.array_except(F.array(*(F.lit(f"{y:04d}-{m:02d}") for y, m in months)), F.coalesce("_have", F.array().cast("array<string>")))
    warnings = F.concat_ws(
        ";",
        F.when(F.col("_have").isNull(), "no_approved_management_allocations").when(F.size(lack) > 0, F.concat(F.lit("missing_approved_management_allocations:"), F.array_join(lack, ","))),
        F.when(F.col("_draft"), "draft_management_allocation_exists"),
        F.when(F.col("quality") == "mixed_currency", "mixed_currency"),
        F.when(F.col("_pools") < 1, "cost_pool_not_applicable"),
    )
    both = both.withColumn("management_cost", total).withColumn("management_result", F.col("revenue") - total)
    return both.select("project_id", "revenue", "cost", "shared_in", "shared_out", (F.col("shared_in") - F.col("shared_out")).alias("net"), "management_cost", "result", "management_result", "margin", margin(F.col("management_result"), F.col("revenue")).alias("management_margin"), warnings.alias("warnings"))


def month_rows(months: DataFrame, entries: DataFrame, versions: DataFrame, listed: list[tuple[int, int]]) -> DataFrame:
    """ledger.month_series() with cost allocated in and out in each month."""
    inside = in_months(entries, versions, listed).withColumn("month", F.make_date("year", "month", F.lit(1)))
    got = inside.groupBy("project_id", "month").agg(F.sum("amount").alias("shared_in"))
    gave = inside.where("source_project_id is not null").groupBy(F.col("source_project_id").alias("project_id"), "month").agg(F.sum("amount").alias("shared_out"))
    return managed_months(months, got, gave)


def rule_month_rows(months: DataFrame, versions: DataFrame, targets: DataFrame, rule: Rule, listed: list[tuple[int, int]]) -> DataFrame:
    """month_rows() of a rule's entries."""
    approved, month = of_status(versions, listed), F.make_date("year", "month", F.lit(1)).alias("month")
    got = received(approved, targets, rule, "year", "month").select("project_id", month, F.col("amount").alias("shared_in"))
    gave = given_by_project(approved, targets, rule, "year", "month").select("project_id", month, F.col("amount").alias("shared_out"))
    return managed_months(months, got, gave)


def managed_months(months: DataFrame, got: DataFrame, gave: DataFrame) -> DataFrame:
    """months with got(project_id, month, shared_in) and gave(project_id, month, shared_out)."""
    both = months.join(got, ["project_id", "month"], "left").join(gave, ["project_id", "month"], "left")
    i, o = F.coalesce("shared_in", money()), F.coalesce("shared_out", money())
    none = F.col("shared_in").isNull() & F.col("shared_out").isNull()
    total = F.col("cost") + i - o
    return both.select("project_id", "month", "revenue", "cost", i.alias("shared_in"), o.alias("shared_out"), (i - o).alias("net"), (F.col("revenue") - total).alias("management_result"), margin(F.col("revenue") - total, F.col("revenue")).alias("management_margin"), none.alias("no_allocations"))


def missing_months(spine: DataFrame, rows: DataFrame) -> DataFrame:
    """(project_id, year, month) of the spine without an approved entry."""
    return spine.join(rows.select("project_id", "year", "month").distinct(), ["project_id", "year", "month"], "left_anti")


def preview(proposal: DataFrame, results: DataFrame) -> DataFrame:
    """proposal(project_id, amount) against management_result(): cost before, current net, total now, and projected."""
    both = proposal.groupBy("project_id").agg(F.sum("amount").alias("new")).join(results.select("project_id", "cost", "shared_in", "shared_out", "management_cost"), "project_id")
    return both.select("project_id", F.col("cost").alias("before"), "shared_in", "shared_out", F.col("management_cost").alias("total"), "new", (F.col("management_cost") + F.col("new")).alias("projected"))


def preselected(rows: DataFrame, criterion: str, source_project: int | None = None) -> DataFrame:
    """rows(project_id, status, revenue, cost, n_allocations, unclassified) with `suggested` by one of five criteria; the source never is."""
    zero = lambda c: F.col(c) == 0
    rules = {
        "none": F.lit(False),
        "positive_revenue": F.col("revenue") > 0,
        "any_revenue": ~zero("revenue"),
        "financial_activity": ~(zero("revenue") & zero("cost") & zero("n_allocations") & zero("unclassified")),
        "active_projects": F.col("status") == "active",
    }
    own = F.lit(False) if source_project is None else F.col("project_id") == source_project
    return rows.withColumn("suggested", rules[criterion] & ~own)


#: Sort key -> its columns, and whether all of them fall.
PRESELECTION = {"revenue": (["revenue", "code"], True), "code": (["code", "project_id"], False), "name": (["lower(name)", "code", "project_id"], False), "status": (["status", "code", "project_id"], False), "cost": (["cost", "code"], True)}


def preselection_order(rows: DataFrame, sort: str, n: int) -> DataFrame:
    """The first n of rows(project_id, code, name, status, revenue, cost) and their `position`; an unknown sort is by revenue."""
    columns, falls = PRESELECTION.get(sort, PRESELECTION["revenue"])
    order = [F.desc(F.expr(c)) if falls else F.asc(F.expr(c)) for c in columns]
    return rows.orderBy(*order).limit(n).withColumn("position", F.row_number().over(W.orderBy(*order)))


def supersede(versions: DataFrame) -> DataFrame:
    """Of the approved versions of a period and source the latest stays approved, the others are superseded."""
    approved = F.col("status") == "approved"
    rank = F.row_number().over(W.partitionBy("period", "source", approved).orderBy(F.desc("approved_at"), F.desc("version")))
    return versions.withColumn("state", F.when(approved & (rank > 1), "superseded").otherwise(F.col("status")))


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("period", "source").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def list_summary(versions: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: versions by status and the sum of all entries."""
    v = versions.agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("draft", "approved", "superseded")))
    return v.join(entries.agg(F.coalesce(F.sum("amount"), money()).alias("total")), F.lit(True))  # two rows
