"""Streams: counters of a sync run, monotonic cursors, the life of alerts, repeats that change nothing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sync_counters(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type in event-time windows; rows later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


CURSOR = "user_id long, cursor timestamp, n_moved long, n_refused long"


def cursors(events: DataFrame) -> DataFrame:
    """One cursor a user that never moves back: how often it moved and how often a move was refused."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        at, moved, refused = state.get if state.exists else (None, 0, 0)
        for ts in sorted(t for b in batches for t in b["ts"]):
            ms = int(pd.Timestamp(ts).value // 1000)
            if at is None or ms > at:
                at, moved = ms, moved + 1
            else:
                refused += 1
        state.update((at, moved, refused))
        yield pd.DataFrame({"user_id": [key[0]], "cursor": [pd.Timestamp(at, unit="us")], "n_moved": [moved], "n_refused": [refused]})

    return events.groupBy("user_id").applyInPandasWithState(step, CURSOR, "at long, moved long, refused long", "update", GroupStateTimeout.NoTimeout)


ALERT = "fingerprint string, action string, status string, n_seen long"


def alert_life(observations: DataFrame) -> DataFrame:
    """observations(fingerprint, seq, met) -> an action for each, in order of seq; a dismissed alert stays so, for ever."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        status, seen = state.get if state.exists else (None, 0)
        out = []
        for _, met in sorted((int(s), m) for b in batches for s, m in zip(b["seq"], b["met"])):
            seen += 1
            if met == "dismiss":
                action = status = "dismissed"
            elif met == "yes":
                action = {None: "opened", "resolved": "reopened", "dismissed": "unchanged"}.get(status, "updated")
                status = status if status == "dismissed" else "open"
            else:
                action = "resolved" if status == "open" else "unchanged"
                status = "resolved" if status == "open" else status
            out.append((key[0], action, status, seen))
        state.update((status, seen))
        yield pd.DataFrame(out, columns=["fingerprint", "action", "status", "n_seen"])

    return observations.groupBy("fingerprint").applyInPandasWithState(step, ALERT, "status string, seen long", "append", GroupStateTimeout.NoTimeout)


LIFE = "fingerprint string, seq long, at timestamp, action string, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which state with timers needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def alert_states(observations: DataFrame, keep: timedelta, late: str = "1 hour") -> DataFrame:
    """observations(fingerprint, ts, seq, verb, until) -> an action for each, in order of (ts, seq), and for each timer.

    Verbs: met and clear report the condition, snooze holds an open alert still until `until`, dismiss ends it for good. A
    snoozed alert wakes by a timer. A resolved one is forgotten `keep` after it was resolved, so that state holds live,
    dismissed and lately resolved alerts; a later `met` opens it anew. Timers are event time and due ones are settled before
    a later row, so the split into batches changes nothing as long as rows come in order. Rows of a fingerprint and batch
    are sorted in its task; bound a batch by the source's options. A null fingerprint is one as any other; rows without a
    time or with another verb change nothing. Start the stream inside rocks().
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    wait = int(keep.total_seconds() * 1000)

    class Life(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.state = handle, handle.getValueState("alert", "status string, due long")

        def handleInputRows(self, key, rows, timerValues):
            status, due = self.state.get() if self.state.exists() else (None, None)
            out = []
            ms = lambda t: None if pd.isna(t) else int(pd.Timestamp(t).value // 1_000_000)
            found = sorted((pd.Timestamp(t).value, int(s), v, ms(u)) for b in rows for t, s, v, u in zip(b["ts"], b["seq"], b["verb"], b["until"]) if not pd.isna(t))
            for ns, seq, verb, until in found:
                if due is not None and ns // 1_000_000 >= due:
                    status, due = self.settle(status, due, key, out)
                action = "unchanged"
                if status == "snoozed" and verb in ("met", "snooze"):
                    action = "held"
                elif status == "dismissed":
                    pass
                elif verb == "met":
                    action = {None: "opened", "resolved": "reopened"}.get(status, "updated")
                    status, due = "open", None
                elif status in ("open", "snoozed"):
                    if verb == "clear":
                        action, status, due = "resolved", "resolved", ns // 1_000_000 + wait
                    elif verb == "dismiss":
                        action, status, due = "dismissed", "dismissed", None
                    elif verb == "snooze" and until is not None:
                        action, status, due = "snoozed", "snoozed", until
                out.append((key[0], seq, pd.Timestamp(ns), action, status))
            self.hold(status, due)
            yield pd.DataFrame(out, columns=["fingerprint", "seq", "at", "action", "status"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            out = []
            if self.state.exists():
                status, due = self.state.get()
                if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
                    self.hold(*self.settle(status, due, key, out))
            yield pd.DataFrame(out, columns=["fingerprint", "seq", "at", "action", "status"])

        def settle(self, status, due, key, out):
            """What a due time does: a snoozed alert wakes, a resolved one is forgotten."""
            if status == "snoozed":
                out.append((key[0], None, pd.Timestamp(due, unit="ms"), "woken", "open"))
                return "open", None
            return None, None

        def hold(self, status, due) -> None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if status is None:
                self.state.clear()
                return
            self.state.update((status, due))
            if due is not None:
                self.handle.registerTimer(due)

        def close(self) -> None:
            pass

    rows = observations.withWatermark("ts", late).groupBy("fingerprint")
    return rows.transformWithStateInPandas(Life(), LIFE, "append", "eventTime")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote; path is a shared folder of its own."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out/epoch=*")
