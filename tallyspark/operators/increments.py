"""Results of projects from cells that changes keep up to date, so that a late or corrected batch costs what it changes.

A cell sums the allocations of one project, day, account, integration and currency. Sums and counts are additive and amounts
exact decimals, so a change needs only the rows before and after it, never the ledger: what went counts -1, what came +1.
Cells lie in a versioned table by project; a change reads and writes the buckets of the projects that it touches. The chart
of accounts is joined when results are asked for, so a new classification changes no cell.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import margin
from ..sources.shared import written
from ..sources.versioned import Table
from . import ledger

KEY = ["project_id", "organization_id", "integration_id", "account_code", "currency", "batch_date"]
CELL = "project_id long, organization_id int, integration_id int, account_code string, currency string, batch_date date, amount decimal(30,6), n long"


def table(spark: SparkSession, path: str, buckets: int = 64) -> Table:
    return Table(spark, path, CELL, "project_id", buckets)


def _summed(rows: DataFrame) -> DataFrame:
    """One row a key with rows' amounts and counts; the types of CELL."""
    g = rows.groupBy(*KEY).agg(F.sum("amount").alias("amount"), F.sum("n").alias("n"))
    kinds = dict(c.rsplit(" ", 1) for c in CELL.split(", "))
    return g.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))


def deltas(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Allocations as they were and as they are (None: there are none) -> what they change in the cells.

    Allocations of no project are in no cell. A correction that moves a batch to another project, day or currency takes
    from one cell and gives to the other; rows that are the same before and after cancel out and touch nothing.
    """
    signed = []
    for rows, sign in ((before, -1), (after, 1)):
        if rows is not None:
            known = rows.where("project_id is not null")
            signed.append(known.select(*KEY, (F.col("amount") * sign).cast("decimal(30,6)").alias("amount"), F.lit(sign).cast("long").alias("n")))
    if not signed:
        raise ValueError("a change needs rows before or after it")
    return _summed(reduce(DataFrame.unionByName, signed)).where("amount <> 0 or n <> 0")


def apply(cells: Table, changes: DataFrame, number: int | None = None) -> int:
    """The version of the cells after deltas(). A number that was applied before changes nothing; removing an allocation
    that no cell holds is an error and leaves the old version."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        held = F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error("a change removes allocations that are not there").cast("long"))
        return _summed(old.unionByName(new)).withColumn("n", held).where("n > 0")

    # the touched buckets are looked up first, so what changes is summed once and read twice
    return cells.change(written(changes, "changes"), merge, number=number)


def results(cells: DataFrame, projects: DataFrame, classification: DataFrame, periods: list[tuple], currency: str | None = None) -> DataFrame:
    """ledger.financials_of() from cells: a row for each project and closed period, without what only batches know
    (their number, that of entries, sync runs, and rows that have a code alone)."""
    date = F.col("batch_date")
    own = [F.when(date.between(ledger.day(a), ledger.day(b)), F.lit(i)) for i, (a, b) in enumerate(periods)]
    inside = reduce(or_, (c.isNotNull() for c in own))
    rows = ledger.base(cells, projects).where(inside | date.isNull()).withColumn("dated", date.isNotNull())
    rows = rows.withColumn("period", F.explode(F.array_compact(F.array(*(F.when(date.isNull(), F.lit(i)).otherwise(c) for i, c in enumerate(own))))))
    keys = ["project_id", "period", "dated", "organization_id", "integration_id", "currency", "account_code"]
    one = rows.groupBy(*keys).agg(F.sum("amount").cast("decimal(30,6)").alias("amount"), F.sum("n").alias("n"))
    routed = ledger.route(ledger.classify(one, classification))
    routed = routed.select("*", F.lit(0).alias("n_entries"), F.lit(None).cast("long").alias("batch_id"), F.lit(None).cast("int").alias("sync_run_id"))
    found = ledger.totals(ledger.currency_rule(ledger.cells(routed, "project_id", "period"), ["project_id", "period"], currency), "project_id", "period")
    every = projects.select("project_id", F.explode(F.array(*(F.lit(i) for i in range(len(periods))))).alias("period"))
    money = (*ledger.BUCKETS, "classified", "result")
    counts = ("n_allocations", "n_unclassified", "n_undated")
    both = every.join(found, ["project_id", "period"], "left").select(
        "project_id", "period", *(F.coalesce(c, ledger.zero()).alias(c) for c in money), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("currency", F.lit(currency or "")).alias("currency"), "currencies"
    )
    mixed = F.lit(False) if currency else F.coalesce(F.size("currencies") > 1, F.lit(False))
    flat = F.array_join(F.coalesce("currencies", F.array()), ",")
    return both.withColumn("margin", margin(F.col("result"), F.col("revenue"))).withColumn("quality", ledger.quality(mixed)).withColumn("currencies", flat)


def changed_results(cells: Table, changes: DataFrame, projects: DataFrame, classification: DataFrame, periods: list[tuple]) -> DataFrame:
    """results() of the projects that deltas() touch and no others: only their buckets of the newest version are read."""
    touched = changes.select("project_id").distinct()
    buckets = {r.b for r in touched.select(cells.bucket().alias("b")).distinct().collect()}  # numbers of buckets
    mine = projects.join(touched, "project_id", "left_semi")
    return results(cells.rows(buckets=buckets), mine, classification, periods)
