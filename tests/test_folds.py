"""Folds by composition against plain Python, with subjects cut into many slices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyspark.operators import events as E, folds


@pytest.mark.parametrize("size", [3, 50, None])
@pytest.mark.parametrize("legal", [E.LINKS, E.CANDIDATES, E.DRAFTS])
def test_table_folds(spark, legal, size):
    rng = np.random.default_rng(4)
    verbs = sorted({v for _, v in legal}) + ["other", None]
    states = sorted({s for s, _ in legal}) + ["gone"]
    subjects = [(k, states[int(rng.integers(0, len(states)))]) for k in range(12)] + [(99, states[0])]
    rows = [(int(rng.integers(0, 3)) * int(rng.integers(0, 4)), n, verbs[int(rng.integers(0, len(verbs)))]) for n in range(400)]
    want = {}
    for k, s in subjects:
        moved = refused = 0
        for _, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            to = legal.get((s, v))
            s, moved, refused = (s, moved, refused + 1) if to is None else (to, moved + 1, refused)
        want[k] = (s, moved, refused)
    got = folds.by_table(spark.createDataFrame(subjects, "k int, state string"), spark.createDataFrame(rows, "k int, seq int, verb string"), "k", legal, size=size)
    assert {r.k: (r.state, r.n_moved, r.n_refused) for r in got.collect()} == want


@pytest.mark.parametrize("size", [2, None])
def test_workflows(spark, size):
    ways = [(1, "draft", "review"), (1, "review", "draft"), (1, "review", "done"), (1, "draft", "parked"), (2, "draft", "done")]
    rng = np.random.default_rng(5)
    starts = [(k, 1 + k % 2, ["draft", "review", "parked"][k % 3]) for k in range(30)]
    rows = [(int(rng.integers(0, 30)), n, ["draft", "review", "done", "parked", None][int(rng.choice(5, p=[0.3, 0.4, 0.1, 0.1, 0.1]))]) for n in range(300)]
    want = {}
    for k, d, s in starts:
        status, n = "active", 2
        for _, _, to in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if status != "active":
                break
            if to is None:
                status, n = "cancelled", n + 2
            elif (d, s, to) in ways:
                s, n = to, n + (3 if to == "done" else 2)
                status = "completed" if to == "done" else "active"
        want[k] = (s, status, n)
    frame = spark.createDataFrame
    got = folds.workflow(frame(starts, "instance int, definition int, state string"), frame(rows, "instance int, seq int, to_state string"), frame(ways, "definition int, from_state string, to_state string"), ["done"], size)
    assert {r.instance: (r.state, r.status, r.n_events) for r in got.collect()} == want


@pytest.mark.parametrize("size", [2, 9, None])
def test_cursors(spark, size):
    rng = np.random.default_rng(6)
    day = lambda: None if rng.random() < 0.05 else dt.date(2020, 1, 1) + dt.timedelta(int(rng.integers(0, 60)))
    rows = [(int(rng.integers(0, 4)), n, day(), bool(rng.random() < 0.08)) for n in range(200)]
    want = {}
    for k in range(4):
        at, refused = None, 0
        for _, _, c, resync in sorted(r for r in rows if r[0] == k):
            if at is None or resync or c is not None and c >= at:
                at = c
            else:
                refused += 1
        want[k] = (at, refused)
    got = folds.guarded_cursor(spark.createDataFrame(rows, "key int, seq int, cursor date, resync boolean"), size)
    assert {r.key: (r.cursor, r.n_refused) for r in got.collect()} == want


def test_one_subject_of_a_million_events(spark):
    verb = F.element_at(F.array(*map(F.lit, ("confirm", "reject", "correct", "acknowledge"))), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int"))
    events = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("seq"), verb.alias("verb")).unionByName(spark.range(50).select(F.lit(2).alias("k"), F.col("id").alias("seq"), F.lit("reject").alias("verb")))
    cut = folds.sliced(events, "k").groupBy("k", "slice").count().collect()
    assert len(cut) == 17 and max(r["count"] for r in cut) < 2 * folds.SLICE
    table = {("suggested", "confirm"): "confirmed", ("confirmed", "reject"): "suggested", ("suggested", "correct"): "suggested"}
    got = {r.k: (r.state, r.n_moved, r.n_refused) for r in folds.by_table(spark.createDataFrame([(1, "suggested"), (2, "confirmed")], "k int, state string"), events, "k", table).collect()}
    s, moved = "suggested", 0
    for v in [r.verb for r in events.where("k = 1").orderBy("seq").select("verb").collect()]:
        if (to := table.get((s, v))) is not None:
            s, moved = to, moved + 1
    assert got == {1: (s, moved, 1_000_000 - moved), 2: ("suggested", 1, 49)}
