"""The life of alerts as a stream with timers: any split into batches gives a plain fold's rows, and state is bounded."""

import random
from datetime import datetime, timedelta

from tallyspark.streaming import state

ROW = "fingerprint string, ts timestamp, seq long, verb string, until timestamp"
T0, KEEP = datetime(2026, 1, 1), timedelta(hours=6)


def fold(rows, end):
    """(fingerprint, seq or None, action) by the rules, one alert after the other, timers up to `end` included."""
    out = []
    for key in {r[0] for r in rows}:
        status, due = None, None
        for _, ts, seq, verb, until in [*sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), (key, end, None, None, None)]:
            if due is not None and ts >= due:
                if status == "snoozed":
                    out.append((key, None, "woken"))
                status, due = ("open" if status == "snoozed" else None), None
            if seq is None:
                continue
            if status == "snoozed" and verb in ("met", "snooze"):
                did = "held"
            elif status == "dismissed":
                did = "unchanged"
            elif verb == "met":
                did = "opened" if status is None else "reopened" if status == "resolved" else "updated"
                status, due = "open", None
            elif status in ("open", "snoozed") and verb == "clear":
                did, status, due = "resolved", "resolved", ts + KEEP
            elif status in ("open", "snoozed") and verb == "dismiss":
                did, status, due = "dismissed", "dismissed", None
            elif status == "open" and verb == "snooze" and until is not None:
                did, status, due = "snoozed", "snoozed", until
            else:
                did = "unchanged"
            out.append((key, seq, did))
    return sorted(out, key=str)


def run(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/b={i:03d}")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/b=*")
    with state.rocks(spark):
        q = state.alert_states(stream, KEEP, "1 second").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return sorted(((r.fingerprint, r.seq, r.action) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()), key=str), kept


def test_batches_equal_a_plain_fold(spark, tmp_path):
    rng, rows, at = random.Random(8), [], T0
    for seq in range(160):
        at += timedelta(minutes=rng.randrange(1, 90))
        verb = rng.choice(["met", "met", "met", "clear", "clear", "snooze", "dismiss" if rng.random() < 0.5 else "met", None])
        rows.append((f"f{rng.randrange(6)}", at, seq, verb, at + timedelta(minutes=rng.randrange(30, 600)) if verb == "snooze" else None))
    end = at + timedelta(days=5)
    rows.append(("last", end, 999, "none", None))
    got, kept = run(spark, tmp_path, [rows[:60], rows[60:61], rows[61:-1], rows[-1:]])
    want = fold(rows, end - timedelta(seconds=1))
    assert got == want
    assert {a for _, _, a in want} == {"opened", "updated", "reopened", "resolved", "snoozed", "held", "woken", "dismissed", "unchanged"}


def test_resolved_alerts_are_forgotten(spark, tmp_path):
    first = [(f"f{i}", T0, i, "met", None) for i in range(40)]
    second = [(f"f{i}", T0 + timedelta(hours=1), 100 + i, "clear" if i % 4 else "dismiss" if i % 8 else "met", None) for i in range(40)]
    third = [("last", T0 + timedelta(days=2), 999, "none", None)]
    _, kept = run(spark, tmp_path, [first, second, third])
    assert kept == 10  # five open and five dismissed alerts; the thirty resolved ones, and their timers, are gone
