"""Scored matching with hot values: against SQL over all pairs, against plain Python, and the number of candidates."""

from decimal import Decimal

import numpy as np
import pytest
from oracle import difference
from pyspark.sql import functions as F
from tallyspark.operators import matching as M
from tallyspark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
STOP = {"aktsiaselts", "as", "fie", "mtu", "osauehing", "osauhing", "ou", "oy", "sa"}
SIDE = "id long, kind string, amount decimal(20,2), party string, number string, account string, tokens array<string>, tie struct<id:long>"


@pytest.mark.parametrize("name", ["j8_bank_bill_match", "j9_ledger_bank_match", "j10_ledger_mail_match", "j12_strict_check"])
def test_all_values_hot(spark, monkeypatch, name):
    monkeypatch.setattr(M, "LIGHT", 1)
    assert difference(spark, QUERIES[name], SQL[name], SF) is None


def rows(rng, n, tokens, accounts):
    """Names with a common start, some within others; references, amounts and accounts that many rows share."""
    names = [f"customer{k}" for k in range(6)] + ["customer", "customer1 north", "north", "oy customer2", "north ridge customer3", None, "ridge north"]
    out = []
    for k in range(n):
        own = sorted({f"ref{int(x)}" for x in rng.integers(0, tokens, int(rng.integers(0, 4)))})
        number = f"ref{int(rng.integers(0, tokens))}" if rng.random() < 0.6 else None
        account = str(int(rng.integers(0, accounts))) if rng.random() < 0.5 else None
        out.append((k, "ab"[int(rng.integers(0, 2))], Decimal(int(rng.integers(0, 9))) / 100 * int(rng.integers(0, 30)), names[int(rng.integers(0, len(names)))], number, account, own, (k,)))
    return out


def words(name):
    import re

    return {w for w in re.findall("[0-9a-z]+", name or "") if len(w) > 1 and w not in STOP}


def plain(left, right, w, threshold):
    """Each left row against all right rows."""
    best = {}
    for i, kind, amount, party, number, account, tokens, _ in left:
        for j, other, amount2, party2, number2, account2, tokens2, _ in right:
            if kind != other:
                continue
            score = w.amount if amount and amount2 and abs(amount - amount2) <= Decimal("0.01") else 0
            score += w.account if w.account and account is not None and account == account2 else 0
            hit = number2 in tokens if w.number_of == "right" else number in tokens2
            score += w.number if hit else w.token if set(tokens) & set(tokens2) else 0
            if party and party2:
                a, b = words(party), words(party2)
                least = min(2, len(a), len(b))
                score += w.party if party in party2 or party2 in party or w.company and least and len(a & b) >= least else 0
            if score >= threshold and (i not in best or score > best[i][1]):
                best[i] = (j, score)
    return best


@pytest.mark.parametrize("w, threshold", [(M.BANK_BILL, 50), (M.LEDGER_BANK, 50), (M.LEDGER_MAIL, 50), (M.LEDGER_BANK, 80)])
def test_equals_all_pairs(spark, w, threshold):
    rng = np.random.default_rng(1)
    left, right = rows(rng, 150, 12, 5), rows(rng, 200, 12, 5)
    l, r = spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE)
    want = plain(left, right, w, threshold)
    for light in (1, 8):
        got = {x.l: (x.r, x.score) for x in M.best_matches(l, r, w, threshold, light).collect()}
        assert got == want


def test_candidates_are_linear(spark):
    """Twice the rows of the same hot values and names: about twice the candidates, not four times."""
    counts = []
    for n in (400, 800):
        rng = np.random.default_rng(3)
        sides = [M.keyed(spark.createDataFrame(rows(rng, n, 6, 3), SIDE), M.BANK_BILL, left) for left in (True, False)]
        counts.append(M.candidates(*sides, M.BANK_BILL, 50, 4).count())
    assert counts[1] < 3 * counts[0]


def test_candidates_of_repeated_amounts(spark):
    """60 right rows of each amount and no other evidence: a left row meets few of them, the first among these."""
    own = lambda at, n: spark.createDataFrame([(k, "a", Decimal(100 + k % 5), f"p{at}{k}", None, None, [f"{at}{k}"], (k,)) for k in range(n)], SIDE)
    left, right = own("l", 50), own("r", 300)
    pairs = M.candidates(M.keyed(left, M.LEDGER_BANK, True), M.keyed(right, M.LEDGER_BANK, False), M.LEDGER_BANK, 50)
    assert pairs.count() <= 10 * left.count()
    assert {(x.l, x.r) for x in M.best_matches(left, right, M.LEDGER_BANK).collect()} == {(k, k % 5) for k in range(50)}


def test_keyed_side_serves_both_matches(spark):
    """A ledger side keyed once gives what a side keyed for each match gives."""
    rng = np.random.default_rng(5)
    left, right = (spark.createDataFrame(rows(rng, n, 12, 5), SIDE) for n in (60, 80))
    once = M.keyed(left, M.LEDGER_BANK, True)
    for w in (M.LEDGER_BANK, M.LEDGER_MAIL):
        assert set(M.best_matches(once, right, w).collect()) == set(M.best_matches(left, right, w).collect())


def test_names_within_names(spark):
    frame = lambda names: spark.createDataFrame([(x,) for x in names], "party string")
    longer, shorter = ["ab", "xabx", "abc", "a", "zz"], ["ab", "a", "bx", "zzz", ""]
    got = {tuple(r) for r in M.held_names(frame(longer), frame(shorter)).collect()}
    assert got == {(x, y) for x in longer for y in shorter if y and y in x}
    assert {tuple(r) for r in M.held_names(frame(longer), frame(shorter), True).collect()} == {p for p in got if p[0] != p[1]}


def test_scores_of_a_pair(spark):
    """A pair with all evidence has the sum of the weights, and an amount of nothing is none."""
    one = spark.createDataFrame([(1, "a", Decimal("5.00"), "x oy", "r1", "7", ["r1"], (1,))], SIDE)
    hit = M.best_matches(one, one, M.BANK_BILL).first()
    assert (hit.score, hit.reasons) == (50 + 35 + 45 + 20, "amount; iban; invoice_number; party")
    none = one.withColumn("amount", F.lit(0).cast("decimal(20,2)"))
    assert M.best_matches(none, none, M.BANK_BILL).first().score == 100
