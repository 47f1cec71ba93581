"""Queries on results that changes keep up to date: a ledger that comes late, is corrected and loses batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import alerts, increments
from ..sources import adapters as A
from ..sources.shared import shared_dir, written
from . import finance
from .registry import doubles, query

LATE, WRONG, GONE = "batch_id % 7 = 2", "batch_id % 11 = 3", "batch_id % 13 = 5"
LEFT = f"FROM (SELECT * FROM routed WHERE NOT ({GONE})) routed WHERE"


def draft(rows: DataFrame) -> DataFrame:
    """The batches as they first came: some with twice the amount, another day and no currency."""
    wrong = F.expr(WRONG)
    rows = rows.withColumn("amount", F.when(wrong, F.col("amount") * 2).otherwise(F.col("amount")).cast("decimal(20,6)"))
    return rows.withColumn("batch_date", F.when(wrong, F.date_add("batch_date", 40)).otherwise(F.col("batch_date"))).withColumn("currency", F.when(wrong, "").otherwise(F.col("currency")))


def kept_cells(spark, d):
    """Cells after four changes: a first load, late batches, corrections and removals."""
    rows = written(A.allocations(spark, d), "allocations")
    cells = increments.table(spark, f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}", 16)
    log = [
        (None, draft(rows.where(f"NOT ({LATE})"))),
        (None, draft(rows.where(LATE))),
        (draft(rows.where(WRONG)), rows.where(WRONG)),
        (rows.where(GONE), None),
    ]
    for number, (before, after) in enumerate(log):
        increments.apply(cells, increments.deltas(before, after), number)
    return cells


FIELDS = "project_id, margin, n_allocations, n_unclassified, currency, currencies, quality"


@query("a1_incremental_results", f", {finance.results_sql().replace('FROM routed WHERE', LEFT)} SELECT {finance.FLAT}, {FIELDS} FROM results")
def a1_incremental(spark, d):
    found = increments.results(kept_cells(spark, d).rows(), A.projects(spark, d), finance.chart(spark), [(finance.START, finance.END)])
    return doubles(found.select(*finance.MONEY, *FIELDS.split(", ")))


@query("x2_alerts_from_cells", f", {finance.FACTS.replace('FROM routed WHERE', LEFT)} SELECT rule_id, project_id, skipped, evaluated, met FROM found")
def x2_from_cells(spark, d):
    today, p = finance.TODAY, A.projects(spark, d)
    both = written(increments.results(kept_cells(spark, d).rows(), p, finance.chart(spark), [("1900-01-01", today), (today[:8] + "01", today)]), "results")
    life, month = (both.where(F.col("period") == i).drop("period") for i in (0, 1))
    return alerts.evaluate(finance.rules(spark), p, life, month, finance.shares(spark, d), today).select("rule_id", "project_id", "skipped", "evaluated", "met")
