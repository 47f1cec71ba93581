"""Cells after any sequence of changes against the whole computation, repeats, refusals and the rows that a change reads."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from tallyspark.operators import increments, ledger
from tallyspark.sources import adapters as A

ROW = "batch_id long, line int, part int, account_code string, amount decimal(20,6), organization_id int, integration_id int, batch_date date, currency string, project_id long, dimension_code string, sync_run_id int"
PERIODS = [("1995-01-01", "1995-01-20"), ("1995-01-10", "1995-02-28")]
SHARED = "period project_id revenue cost unclassified excluded classified result margin n_allocations n_unclassified currency currencies quality".split()


@pytest.fixture
def projects(spark):
    return spark.createDataFrame([(i, 1 + i % 2, f"P{i}") for i in range(12)], "project_id long, organization_id int, code string")


def frame(spark, rows):
    return spark.createDataFrame([r for part in rows for r in part], ROW)


def batch(rng, number):
    day = None if rng.random() < 0.1 else datetime.date(1995, 1, 1) + datetime.timedelta(rng.randrange(60))
    project = None if rng.random() < 0.1 else rng.randrange(12)
    head = (1 + rng.randrange(2), 1 + rng.randrange(3), day, rng.choice(["EUR", "EUR", "EUR", "", "USD"]), project, "x", None)
    from decimal import Decimal

    return [(number, i, 0, rng.choice(["3000", "5000", "5100", "9999", "1"]), Decimal(rng.randrange(-500, 500)) / 100, *head) for i in range(rng.randrange(1, 4))]


def plain(df):
    return sorted(tuple(str(r[c]) for c in SHARED) for r in df.collect())


def test_changes_equal_the_whole(spark, tmp_path, projects):
    rng, cells, held = random.Random(4), increments.table(spark, f"file://{tmp_path}/cells", 8), {}
    for number in range(5):
        before, after = [], []
        for b in range(30):
            if rng.random() < (1 if number == 0 else 0.25):
                before.append(held.pop(b, []))
                if number == 0 or rng.random() < 0.7:
                    held[b] = batch(rng, b)
                    after.append(held[b])
        changes = increments.deltas(frame(spark, before), frame(spark, after))
        version = increments.apply(cells, changes, number)
        assert increments.apply(cells, changes, number) == version  # a repeat changes nothing
        want = plain(ledger.financials_of(frame(spark, held.values()), projects, A.classification(spark), PERIODS))
        got = increments.results(cells.rows(), projects, A.classification(spark), PERIODS)
        assert plain(got) == want and len(want) == 24
        touched = {str(r.project_id) for r in changes.collect()}
        some = plain(increments.changed_results(cells, changes, projects, A.classification(spark), PERIODS))
        assert some == [r for r in want if r[1] in touched]
    usd = plain(increments.results(cells.rows(), projects, A.classification(spark), PERIODS, "USD"))
    assert usd == plain(ledger.financials_of(frame(spark, held.values()), projects, A.classification(spark), PERIODS, "USD"))


def test_a_change_writes_its_projects_only(spark, tmp_path, projects):
    rng, cells = random.Random(5), increments.table(spark, f"file://{tmp_path}/cells", 16)
    first = [batch(rng, b) for b in range(60)]
    increments.apply(cells, increments.deltas(None, frame(spark, first)), 0)
    old = cells.folders(cells.version())
    one = next(b for b in first if b[0][9] is not None)
    increments.apply(cells, increments.deltas(frame(spark, [one]), None), 1)
    new = cells.folders(cells.version())
    assert sum(old.get(b) != new.get(b) for b in old.keys() | new.keys()) == 1
    assert cells.upto() == 1


def test_removing_what_is_not_there(spark, tmp_path):
    rng, cells = random.Random(6), increments.table(spark, f"file://{tmp_path}/cells", 4)
    rows = [b for b in (batch(rng, i) for i in range(9)) if b[0][9] is not None]
    increments.apply(cells, increments.deltas(None, frame(spark, rows[:2])), 0)
    with pytest.raises(Exception, match="not there"):
        increments.apply(cells, increments.deltas(frame(spark, rows[2:]), None), 1)
    assert cells.version() == 1 and cells.upto() == 0


def test_equal_rows_touch_nothing(spark, tmp_path):
    rows = frame(spark, [batch(random.Random(7), 1)])
    assert increments.deltas(rows, rows).count() == 0
    with pytest.raises(ValueError):
        increments.deltas(None, None)
