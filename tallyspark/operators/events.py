"""State that follows from ordered events: reviews, workflows, sync runs. Folds are in folds.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .folds import by_table as fold, guarded_cursor, workflow  # noqa: F401

# What may follow what.
LINKS = {("suggested", "confirm"): "confirmed", ("suggested", "reject"): "rejected", ("confirmed", "reject"): "rejected", ("suggested", "correct"): "corrected", ("confirmed", "correct"): "corrected", ("rejected", "confirm"): "confirmed"}
CANDIDATES = {("pending_review", "approve"): "approved", ("pending_review", "edit"): "edited_and_approved", ("pending_review", "reject"): "rejected", ("pending_review", "merge"): "merged", ("pending_review", "ignore"): "ignored"}
DRAFTS = {("draft", "edit"): "draft", ("draft", "approve"): "approved", ("draft", "reject"): "rejected", ("approved", "send"): "sent"}


def legal_transitions(instances: DataFrame, transitions: DataFrame) -> DataFrame:
    """Transitions that start at an instance's current state."""
    return instances.join(transitions.withColumnRenamed("from_state", "current_state"), ["definition", "current_state"])


def sync_run(chunks: DataFrame) -> DataFrame:
    """chunks(run, seq, period_end, n, failed): each run's cursor at the end of the last chunk before its first failure, what
    it persisted and its status; earlier progress stays."""
    first = chunks.where("failed").groupBy("run").agg(F.min("seq").alias("_stop"))
    done = chunks.join(first, "run", "left").where("_stop is null or seq < _stop")
    ok = done.groupBy("run").agg(F.max("period_end").alias("cursor"), F.sum("n").alias("n_rows"), F.count("*").alias("n_chunks"))
    all_ = chunks.groupBy("run").agg(F.max("failed").alias("_f"))
    return all_.join(ok, "run", "left").select("run", "cursor", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(~F.col("_f"), "completed").when(F.col("n_chunks") > 0, "partial").otherwise("failed").alias("status"))


def epoch_changes(stored: DataFrame, seen: DataFrame, key: str = "mailbox") -> DataFrame:
    """Mailboxes whose epoch isn't the stored one: they need recovery by hand, and nothing of them is read."""
    s = stored.select(key, F.col("epoch").alias("_was"))
    return seen.join(s, key).select(key, F.when(F.col("_was").isNull(), "new").when(F.col("_was") == F.col("epoch"), "same").otherwise("needs_recovery").alias("state"))
