"""Versioned tables: trees of batches after any sequence of changes, concurrent writers, killed writers."""

import random

import pytest
from pyspark.sql import functions as F
from tallyspark.operators import trees
from tallyspark.sources import versioned


@pytest.fixture
def table(spark, tmp_path):
    return versioned.Table(spark, f"file://{tmp_path}/t", trees.NODE, "root", 8)


def frame(spark, nodes):
    return spark.createDataFrame([(p.split("/")[0], p, "batch entry allocation".split()[p.count("/")], f) for p, f in nodes.items()], trees.NODE)


def plain(table, version=None):
    return {r.path: r.fields for r in table.rows(version).collect()}


def test_sequences_of_changes(spark, table):
    rng, want, history = random.Random(3), {}, [{}]
    for _ in range(5):
        new = {}
        for _ in range(12):
            b, e, a = f"b{rng.randrange(6)}", rng.randrange(3), rng.randrange(2)
            for p in (b, f"{b}/e{e}", f"{b}/e{e}/a{a}")[: rng.randrange(1, 4)]:
                new[p] = {"amount": str(rng.randrange(4)), "memo": None}
        gone = [p for p in want if rng.random() < 0.1]
        removed = spark.createDataFrame([(p.split("/")[0], p) for p in gone], "root string, path string")
        trees.upsert(table, frame(spark, new), removed)
        want = {p: f for p, f in want.items() if p in new or not any(p == g or p.startswith(g + "/") for g in gone)} | new
        history.append(want)
        assert plain(table) == want
    for version, then in enumerate(history):  # older versions stay readable
        assert plain(table, version) == then


def test_only_touched_buckets_are_written(spark, table):
    trees.upsert(table, frame(spark, {f"b{k}": {"amount": "1"} for k in range(40)}))
    before = table.folders(1)
    trees.upsert(table, frame(spark, {"b3": {"amount": "2"}}))
    after = table.folders(2)
    assert sum(before[b] != after[b] for b in before) == 1 and plain(table)["b3"] == {"amount": "2"} and len(plain(table)) == 40


def test_one_of_two_writers_is_refused(spark, table):
    one, two = frame(spark, {"b1": {"amount": "1"}}), frame(spark, {"b2": {"amount": "2"}})
    trees.upsert(table, one, base=0)
    with pytest.raises(versioned.Refused):
        trees.upsert(table, two, base=0)
    assert plain(table) == {"b1": {"amount": "1"}}
    trees.upsert(table, two)
    assert set(plain(table)) == {"b1", "b2"}


def test_a_killed_writer_leaves_the_old_version(spark, table, monkeypatch):
    trees.upsert(table, frame(spark, {"b1": {"amount": "1"}}))
    # killed before the manifest: only a folder is left
    monkeypatch.setattr(versioned.Table, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        trees.upsert(table, frame(spark, {"b1": {"amount": "9"}}))
    monkeypatch.undo()
    assert table.version() == 1 and plain(table) == {"b1": {"amount": "1"}}
    # killed within the manifest: no version, and it holds others off for a while only
    out = table.fs.create(table._at(f"{table.path}/versions/{2:08d}"), False)
    out.write(bytearray(b'{"base": 1, "buck'))
    out.close()
    assert table.version() == 1 and plain(table) == {"b1": {"amount": "1"}}
    with pytest.raises(versioned.Refused):
        trees.upsert(table, frame(spark, {"b2": {"amount": "2"}}))
    monkeypatch.setattr(versioned, "LEASE", 0)
    assert trees.upsert(table, frame(spark, {"b2": {"amount": "2"}})) == 3 and set(plain(table)) == {"b1", "b2"}


def test_actions(spark):
    stored = frame(spark, {"b": {"x": "1"}, "b/e": {"x": "1"}, "b/e/a": {"x": None}, "c": {"x": "1"}, "c/e": {}})
    incoming = frame(spark, {"b": {"x": "1"}, "b/e": {"x": "2"}, "d": {"x": "1"}})
    removed = spark.createDataFrame([("c", "c")], "root string, path string")
    got = {r.path: r.action for r in trees.compared(stored, incoming, removed).collect()}
    assert got == {"b": "unchanged", "b/e": "updated", "b/e/a": "kept", "c": "removed", "c/e": "removed", "d": "created"}
    assert trees.nodes(spark.createDataFrame([("a/b", 1, 2.5)], "k string, n int, v double"), "entry", ["k", "n"], ["v"]).select("root", "path", F.col("fields")["v"]).first()[:] == ("a%2Fb", "a%2Fb/1", "2.5")


def test_one_shuffle_compares(spark):
    """Both sides and the removed paths meet by their root in one shuffle; a removed branch goes, but for what comes in."""
    stored = frame(spark, {"b1": {"v": "1"}, "b1/2": {"v": "1"}, "b1/2/x": {"v": "1"}, "b1/20": {"v": "1"}, "b2": {"v": "1"}})
    incoming = frame(spark, {"b1/2/y": {"v": "2"}, "b2": {"v": "1"}, "b1": {"v": "3"}})
    removed = spark.createDataFrame([("b1", "b1/2"), ("b2", "b2"), ("b3", "b3")], "root string, path string")
    done = trees.compared(stored, incoming, removed)
    got = {r.path: (r.action, r.fields["v"]) for r in done.collect()}
    assert got == {"b1": ("updated", "3"), "b1/2": ("removed", "1"), "b1/2/x": ("removed", "1"), "b1/20": ("kept", "1"), "b1/2/y": ("created", "2"), "b2": ("unchanged", "1")}
    assert str(done._jdf.queryExecution().executedPlan().toString()).split("== Initial Plan ==")[-1].count("Exchange ") == 1
