"""Upserts as comparisons: the incoming state against the stored one, with an action for each key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.fingerprint import joined
from ..sources.shared import shared_dir


def diff(stored: DataFrame, incoming: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """created, updated, unchanged or absent for each key; a key that is absent from the incoming rows stays."""
    s, i = stored.select(key, F.struct(*compare).alias("_s")), incoming.select(key, F.struct(*compare).alias("_i"))
    both = s.join(i, key, "full_outer")
    action = F.when(F.col("_s").isNull(), "created").when(F.col("_i").isNull(), "absent").when(F.col("_s").eqNullSafe(F.col("_i")), "unchanged").otherwise("updated")
    return both.select(key, action.alias("action"), F.coalesce("_i", "_s").alias("_row")).select(key, "action", "_row.*")


def merge_filled(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values that are not empty win; empty ones leave the old."""
    i = incoming.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return stored.join(i, key, "full_outer").select(key, *(F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c) for c in columns))


def seen_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each fingerprint of the columns, with how often it was seen."""
    return rows.withColumn("fingerprint", joined(*columns)).groupBy("fingerprint").agg(F.count("*").alias("seen_count"), *(F.first(c).alias(c) for c in columns))


def conflicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(external_id, code): a code twice in the incoming rows, a stored code of another id, a stored id of another code."""
    twice = incoming.withColumn("_n", F.count("*").over(W.partitionBy("code"))).where("_n > 1").select("external_id", "code", F.lit("duplicate_code").alias("kind"))
    s = stored.select(F.col("external_id").alias("_id"), F.col("code").alias("_code"))
    other_id = incoming.join(s, incoming.code == s["_code"]).where("external_id <> _id").select("external_id", "code", F.lit("code_of_other_id").alias("kind"))
    other_code = incoming.join(s, incoming.external_id == s["_id"]).where("code <> _code").select("external_id", "code", F.lit("id_of_other_code").alias("kind"))
    return twice.unionByName(other_id).unionByName(other_code).distinct()


def archived(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows that neither id nor code of the incoming rows names."""
    return stored.join(incoming.select("external_id"), "external_id", "left_anti").join(incoming.select("code"), "code", "left_anti")


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_roots(links: DataFrame) -> DataFrame:
    """links(node, into), one a node: (node, root, cyclic), the end of each chain of merges by pointer doubling, whatever its
    length; what leads into a cycle has no end. Each doubling is a written table."""
    spark = links.sparkSession
    step, n = links.select("node", "into", F.lit(1).cast("long").alias("hops")), links.count()
    path = f"{shared_dir(spark)}/roots-{uuid.uuid4().hex}"
    for k in range(n.bit_length() + 1):  # one round more than any chain needs, so what still moves is a cycle
        nxt = step.select(F.col("node").alias("_n"), F.col("into").alias("_i"), F.col("hops").alias("_h"))
        moved = step.join(nxt, step["into"] == nxt["_n"], "left").select("node", F.coalesce("_i", "into").alias("into"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.col("_n").isNotNull().alias("moved"))
        moved.write.parquet(f"{path}/{k}")
        step = spark.read.schema(moved.schema).parquet(f"{path}/{k}")
        if step.where("moved").isEmpty():
            break
    return step.select("node", F.when(~F.col("moved"), F.col("into")).alias("root"), F.col("moved").alias("cyclic"))


def sync_dimensions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(external_id, code, action): created, updated or unchanged by id first and else by code, conflict where conflicts()
    finds one, archived where the incoming rows lack it."""
    bad = conflicts(incoming, stored).select("external_id", "code").distinct().withColumn("_bad", F.lit(True))
    x = incoming.join(bad, ["external_id", "code"], "left")
    by_id = stored.select("external_id", F.col("code").alias("_c1"), F.lit(True).alias("_by_id"))
    by_code = stored.select("code", F.lit(True).alias("_by_code")).distinct()
    x = x.join(by_id, "external_id", "left").join(by_code, "code", "left")
    action = F.when(F.col("_bad"), "conflict").when(F.col("_by_id"), F.when(F.col("code") == F.col("_c1"), "unchanged").otherwise("updated")).when(F.col("_by_code"), "updated").otherwise("created")
    gone = archived(stored, incoming).select("external_id", "code", F.lit("archived").alias("action"))
    return x.select("external_id", "code", action.alias("action")).unionByName(gone)


def resolve_conflicts(rows: DataFrame) -> DataFrame:
    """rows(id, resolution, local_code, incoming_code): the code and status after keep_local, accept_incoming, mark_inactive or
    manual_review."""
    r = F.col("resolution")
    return rows.select("id", F.when(r == "accept_incoming", F.col("incoming_code")).otherwise(F.col("local_code")).alias("code"), F.when(r == "mark_inactive", "inactive").when(r == "manual_review", "in_review").otherwise("active").alias("status"))


def local_dimension(conflicts_: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(conflict_id, dimension_id): the local dimension that a conflict means: its ids in order, then its codes."""
    keys = lambda c, base: F.transform(c, lambda x, i: F.struct((F.lit(base) + i).alias("p"), x.alias("k")))
    found = None
    for column, name, base in (("ids", "external_id", 0), ("codes", "code", 1000)):
        part = conflicts_.select("conflict_id", F.explode(keys(F.col(column), base)).alias("x")).select("conflict_id", "x.p", F.col("x.k").alias(name)).join(dimensions.select("dimension_id", name), name).select("conflict_id", "p", "dimension_id")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("conflict_id").agg(F.min_by("dimension_id", F.struct("p", "dimension_id")).alias("dimension_id"))


def first_conflict(rows: DataFrame, key: str, id_: str, position: str) -> DataFrame:
    """Rows of one payload whose key was first seen with another id."""
    first = rows.groupBy(key).agg(F.min_by(id_, position).alias("_first"))
    return rows.join(first, key).where(F.col(id_) != F.col("_first")).select(key, id_, F.col("_first").alias("first_id"))


def last_write(stored: DataFrame, writes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Settings after all writes: the last one of each key, else what was stored."""
    last = writes.groupBy(key).agg(F.max_by(value, order).alias("_v"))
    return stored.join(last, key, "full_outer").select(key, F.coalesce("_v", value).alias(value))


def set_status(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows(key, status), changes(key, new_status, at): the new status with its time in confirmed_at or rejected_at."""
    both = rows.join(changes.select(key, "new_status", "at"), key, "left")
    stamp = lambda s: F.when(F.col("new_status") == s, F.col("at")).alias(f"{s}_at")
    return both.select(key, F.coalesce("new_status", "status").alias("status"), stamp("confirmed"), stamp("rejected"))


def persist_pending(stored: DataFrame, fresh: DataFrame, key: str, value: str, pending: str = "pending_review") -> DataFrame:
    """Fresh rows against stored ones: new, changed while still pending, or left alone once reviewed."""
    f = fresh.select(key, F.col(value).alias("_v"))
    both = stored.join(f, key, "full_outer")
    action = F.when(F.col("status").isNull(), "created").when(F.col("_v").isNull(), "absent").when(F.col("status") != pending, "skipped").when(F.col("_v") == F.col(value), "unchanged").otherwise("updated")
    return both.select(key, action.alias("action"), F.when(action.isin("created", "updated"), F.col("_v")).otherwise(F.col(value)).alias(value))


def not_extracted(rows: DataFrame, done: DataFrame, text: str, version: int) -> DataFrame:
    """Rows whose content, by fingerprint, this version of the extraction hasn't seen."""
    marked = rows.withColumn("fingerprint", joined(text))
    return marked.join(done.where(F.col("version") == version).select("fingerprint"), "fingerprint", "left_anti")


def save_classes(stored: DataFrame, changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """(account_code, category, action): a change holds for accounts that the ledger has; each is one audited row."""
    known = changes.join(ledger.select("account_code").distinct(), "account_code", "left_semi")
    both = stored.select("account_code", F.col("category").alias("_was")).join(known, "account_code", "full_outer")
    action = F.when(F.col("category").isNull(), "kept").when(F.col("_was").isNull(), "created").when(F.col("_was") == F.col("category"), "unchanged").otherwise("updated")
    return both.select("account_code", F.coalesce("category", "_was").alias("category"), action.alias("action"))


def next_code(used: DataFrame, prefix: str = "", least: int | None = None) -> DataFrame:
    """One row: the next free number behind a prefix, from `least` or behind the largest, as wide as the widest in use.

    Gaps are found by joining each used number to the one before it, so no sequence of all numbers is made.
    """
    n = used.where(F.col("code").startswith(prefix)).select(F.substr("code", F.lit(len(prefix) + 1)).alias("s")).where(r"s rlike '^[0-9]+$'").select(F.col("s").cast("long").alias("n"), F.length("s").alias("w"))
    top = n.agg(F.max("n").alias("top"), F.max("w").alias("w"))
    if least is None:
        free = top.select((F.coalesce("top", F.lit(0)) + 1).alias("n"), "w")
    else:
        taken = n.select("n").where(F.col("n") >= least).distinct()
        ends = taken.join(taken.select((F.col("n") - 1).alias("n")), "n", "left_anti")  # no used number follows
        starts = taken.where(F.col("n") == least).agg(F.count("*").alias("c"))
        free = ends.agg(F.min("n").alias("e")).join(starts, F.lit(True)).join(top, F.lit(True)).select(F.when(F.col("c") == 0, F.lit(least)).otherwise(F.col("e") + 1).alias("n"), "w")
    digits = F.col("n").cast("string")
    return free.select(F.concat(F.lit(prefix), F.when(F.lit(bool(prefix)), F.lpad(digits, F.greatest(F.coalesce("w", F.lit(1)), F.length(digits)), F.lit("0"))).otherwise(digits)).alias("code"))
