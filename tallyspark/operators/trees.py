"""Upsert of a tree: batches, their entries and their allocations, as nodes of one versioned table.

A node is (root, path, kind, fields): the batch it hangs on, the identities down to it, and its values by name. Incoming
nodes create or update; nodes that an incoming batch doesn't name stay; a removed path takes its whole branch with it. All
nodes of a batch are in one bucket, so a change reads and writes the buckets of its batches alone, and all levels change in
one version or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

NODE = "root string, path string, kind string, fields map<string,string>"


def nodes(rows: DataFrame, kind: str, ids: list[str], fields: list[str]) -> DataFrame:
    """Rows as nodes; ids: the columns from the batch's identity down to the row's own."""
    parts = [F.regexp_replace(F.col(c).cast("string"), "/", "%2F") for c in ids]
    values = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(c).cast("string") for c in fields)))
    return rows.select(parts[0].alias("root"), F.concat_ws("/", *parts).alias("path"), F.lit(kind).alias("kind"), values.alias("fields"))


def _entries(c):
    return F.array_sort(F.map_entries(c))


def compared(stored: DataFrame, incoming: DataFrame, removed: DataFrame) -> DataFrame:
    """Every node of either side with its `action`: created, updated, unchanged, kept or removed. removed(root, path). A path
    stands once on each side."""
    node, no_node = F.struct("kind", "fields"), F.lit(None).cast("struct<kind:string,fields:map<string,string>>")
    part = lambda rows, old, new, out: rows.select("root", "path", old.alias("_old"), new.alias("_new"), F.lit(out).alias("_out"))
    rows = part(stored, node, no_node, False).unionByName(part(incoming, no_node, node, False)).unionByName(part(removed, no_node, no_node, True))
    # one shuffle by root: paths of both sides meet in it, and so do the paths that its removed ones hold
    one = rows.repartition("root").groupBy("root", "path").agg(F.first("_old", True).alias("_old"), F.first("_new", True).alias("_new"), F.max("_out").alias("_out"))
    one = one.withColumn("_gone", F.collect_set(F.when(F.col("_out"), F.col("path"))).over(W.partitionBy("root")))
    old, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    out = F.exists("_gone", lambda g: (F.col("path") == g) | F.startswith(F.col("path"), F.concat(g, F.lit("/"))))
    same = _entries(F.col("_old.fields")).eqNullSafe(_entries(F.col("_new.fields")))
    action = F.when(new & ~old, "created").when(new & same, "unchanged").when(new, "updated").when(out, "removed").otherwise("kept")
    newest = F.coalesce("_new", "_old")
    return one.where(old | new).select("root", "path", F.coalesce("_new.kind", "_old.kind").alias("kind"), newest["fields"].alias("fields"), action.alias("action"))


def upsert(table, incoming: DataFrame, removed: DataFrame | None = None, base: int | None = None) -> int:
    """The table's version after the change. A path that is removed and incoming in one change stays as incoming."""
    removed = removed if removed is not None else incoming.select("root", "path").limit(0)
    changes = incoming.select("root", "path", "kind", "fields", F.lit(False).alias("gone")).unionByName(removed.select("root", "path", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("map<string,string>").alias("fields"), F.lit(True).alias("gone")))

    def merge(stored, c):
        done = compared(stored, c.where("not gone").drop("gone"), c.where("gone").select("root", "path"))
        return done.where("action <> 'removed'").drop("action")

    return table.change(changes, merge, base)
