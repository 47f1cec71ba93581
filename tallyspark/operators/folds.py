"""Folds of ordered events by composition.

A run of a subject's events is a function of the state before it: for every state in which anything can still happen, the
state after it and what was counted on the way. Such functions are composed in order, so a subject of many events is cut
into slices by its own order, each is folded by a task of its own from every live state, and what meets in one row of the
subject is one small array a slice. Subjects of up to SLICE events are one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.shared import written

#: Events of a subject that one task may fold, and the parts that a larger subject's order is measured in.
SLICE, PARTS = 65_536, 1000


def sliced(events: DataFrame, key: str, seq: str = "seq", size: int | None = None) -> DataFrame:
    """events with `slice`, which rises with seq (a number, date or time). Cuts are quantiles of a large subject's own order,
    written once so that every attempt of a task cuts alike; events of one seq stay together."""
    size = SLICE if size is None else size
    counts = events.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    shares = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    marks = events.join(counts, key).groupBy(key).agg(F.percentile_approx(seq, shares, F.lit(10 * PARTS)).alias("_marks"), F.first("_n").alias("_n"))
    many = F.least(F.ceil(F.col("_n") / size), F.lit(PARTS)).cast("int").alias("_many")
    chosen = F.expr(f"transform(sequence(1, _many - 1), i -> element_at(_marks, cast(i * {PARTS} div _many as int)))")
    cuts = written(marks.select(key, "_marks", many).select(key, F.array_distinct(chosen).alias("_cuts")), "cuts")
    at = F.size(F.filter("_cuts", lambda c: c < F.col(seq)))
    return events.join(cuts, key, "left").withColumn("slice", F.coalesce(F.when(F.col("_cuts").isNotNull(), at), F.lit(0))).drop("_cuts")


def folded(lists: DataFrame, keys: list[str], states: Column, start, step) -> DataFrame:
    """lists(*keys, slice, steps) -> (*keys, slice, n, ends): for each of `states` (an array) what start(state) becomes by
    step over the slice's steps, with the state itself as `before`."""

    def end(s):
        done = F.aggregate("steps", start(s), step)
        return F.struct(s.alias("before"), done.alias("after"))

    return lists.select(*keys, "slice", F.size("steps").alias("n"), F.transform(states, end).alias("ends"))


def composed(subjects: DataFrame, slices: DataFrame, key: str, start: Column, state: str, add) -> DataFrame:
    """subjects with `_e`: start taken through the subject's slices in order. add(a, found, n) is a after a slice of n steps,
    found: its end from a's state, null where nothing can happen in that state."""
    runs = slices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slice", "n", "ends"))).alias("_runs"))
    both = subjects.join(runs, key, "left")

    def go(a, r):
        found = F.get(F.filter(r["ends"], lambda e: e["before"] == a[state]), F.lit(0))
        return add(a, found["after"], r["n"])

    return both.withColumn("_e", F.when(F.col("_runs").isNull(), start).otherwise(F.aggregate("_runs", start, go))).drop("_runs")


def by_table(subjects: DataFrame, events: DataFrame, key: str, legal: dict[tuple[str, str], str], state: str = "state", size: int | None = None) -> DataFrame:
    """subjects(key, state), events(key, seq, verb) -> (key, state, n_moved, n_refused) by a table of (state, verb) -> state."""
    table = F.create_map(*(F.lit(x) for (s, v), t in legal.items() for x in (f"{s}/{v}", t)))
    live = F.array(*(F.lit(s) for s in sorted({s for s, _ in legal})))
    one = lambda s, moved, refused: F.struct(s.alias("state"), moved.cast("long").alias("moved"), refused.cast("long").alias("refused"))
    start = lambda s: one(s, F.lit(0), F.lit(0))

    def step(a, e):
        to = F.try_element_at(table, F.concat_ws("/", a["state"], e["verb"]))
        return one(F.coalesce(to, a["state"]), a["moved"] + F.when(to.isNull(), 0).otherwise(1), a["refused"] + F.when(to.isNull(), 1).otherwise(0))

    def add(a, found, n):
        return one(F.coalesce(found["state"], a["state"]), a["moved"] + F.coalesce(found["moved"], F.lit(0)), a["refused"] + F.coalesce(found["refused"], n))

    lists = sliced(events, key, size=size).groupBy(key, "slice").agg(F.array_sort(F.collect_list(F.struct("seq", "verb"))).alias("steps"))
    done = composed(subjects, folded(lists, [key], live, start, step), key, start(F.col(state)), "state", add)
    return done.select(key, F.col("_e.state").alias("state"), F.col("_e.moved").alias("n_moved"), F.col("_e.refused").alias("n_refused"))


def workflow(starts: DataFrame, events: DataFrame, transitions: DataFrame, final: list[str], size: int | None = None) -> DataFrame:
    """Instances after their events: (instance, state, status, n_events).

    starts(instance, definition, state), events(instance, seq, to_state or null to cancel), transitions(definition, from_state,
    to_state). A legal move writes two events, one into a final state three, a start two and a cancellation two; after an end
    nothing moves. Any state may be cancelled, so states that no transition leaves are live too, by the name "".
    """
    ways = transitions.groupBy("definition").agg(F.collect_set(F.concat_ws(">", "from_state", "to_state")).alias("_ways"), F.collect_set("from_state").alias("_from"))
    one = lambda state, status, n: F.struct(state.alias("state"), status.alias("status"), n.cast("long").alias("n"))
    fresh = lambda s: one(s, F.lit("active"), F.lit(0))

    def step(a, e):
        live, way = a["status"] == "active", F.array_contains("_ways", F.concat_ws(">", a["state"], e["to_state"]))
        moved = one(e["to_state"], F.when(e["to_state"].isin(final), "completed").otherwise("active"), a["n"] + F.when(e["to_state"].isin(final), 3).otherwise(2))
        return F.when(live & e["to_state"].isNull(), one(a["state"], F.lit("cancelled"), a["n"] + 2)).when(live & way, moved).otherwise(a)

    # every definition's ways are known before the events are cut; a large instance's side of the join is split by Spark
    known = events.join(starts.select("instance", "definition"), "instance")
    lists = sliced(known, "instance", size=size).groupBy("instance", "definition", "slice").agg(F.array_sort(F.collect_list(F.struct("seq", "to_state"))).alias("steps"))
    lists = lists.join(ways.withColumnRenamed("definition", "_d"), F.col("definition") == F.col("_d"))
    ends = folded(lists, ["instance"], F.concat("_from", F.array(F.lit(""))), fresh, step)

    def add(a, found, n):
        kept = F.when(found["state"] == "", a["state"]).otherwise(found["state"])
        return F.when((a["status"] == "active") & found.isNotNull(), one(kept, found["status"], a["n"] + found["n"])).otherwise(one(a["state"], a["status"], a["n"]))

    subjects = starts.join(ways, "definition").withColumn("_at", F.when(F.array_contains("_from", F.col("state")), F.col("state")).otherwise(""))
    full = lambda at, a: F.struct(at.alias("at"), a["state"].alias("state"), a["status"].alias("status"), a["n"].alias("n"))

    def go(a, found, n):
        b = add(a, found, n)
        return full(F.when(F.array_contains("_from", b["state"]), b["state"]).otherwise(""), b)

    begin = full(F.col("_at"), one(F.col("state"), F.lit("active"), F.lit(2)))
    done = composed(subjects, ends, "instance", begin, "at", go)
    return done.select("instance", F.col("_e.state").alias("state"), F.col("_e.status").alias("status"), F.col("_e.n").alias("n_events"))


def guarded_cursor(runs: DataFrame, size: int | None = None) -> DataFrame:
    """runs(key, seq, cursor, resync): each key's cursor after its runs; it never moves back but in a resync, which sets it.

    A slice leaves behind whether it was reset and its largest cursor since; with what stands before it each slice is then
    folded once more for the moves that were refused.
    """
    lists = sliced(runs, "key", size=size).groupBy("key", "slice").agg(F.array_sort(F.collect_list(F.struct("seq", "cursor", "resync"))).alias("steps"))
    none = F.struct(F.lit(False).alias("reset"), F.lit(None).cast("date").alias("at"))
    pair = lambda reset, at: F.struct(reset.alias("reset"), at.alias("at"))
    left = F.aggregate("steps", none, lambda a, e: F.when(e["resync"], pair(F.lit(True), e["cursor"])).otherwise(pair(a["reset"], F.greatest(a["at"], e["cursor"]))))
    then = lambda a, r: F.when(r["left"]["reset"], pair(F.lit(True), r["left"]["at"])).otherwise(pair(a["reset"], F.greatest(a["at"], r["left"]["at"])))
    ends = lists.select("key", "slice", left.alias("left"))
    earlier = F.collect_list(F.struct("slice", "left")).over(W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    begins = written(ends.select("key", "slice", "left", F.aggregate(earlier, none, then)["at"].alias("begin")), "cursors")

    def step(a, e):
        ok = a["at"].isNull() | (e["cursor"] >= a["at"]) | e["resync"]
        return F.struct(F.when(ok, e["cursor"]).otherwise(a["at"]).alias("at"), (a["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    start = F.struct(F.col("begin").alias("at"), F.lit(0).alias("refused"))
    each = lists.join(begins.select("key", "slice", "begin"), ["key", "slice"]).select("key", "slice", F.aggregate("steps", start, step).alias("e"))
    return each.groupBy("key").agg(F.max_by("e.at", "slice").alias("cursor"), F.sum("e.refused").alias("n_refused"))
