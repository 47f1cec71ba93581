"""Multi-pattern search against a search for each pattern."""

import re

import numpy as np
import pytest
from tallyspark.operators import messages, patterns


@pytest.mark.parametrize("held", [None, 30])
@pytest.mark.parametrize("alone", [True, False])
def test_equals_single_searches(spark, alone, held):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abA1-. ÕÜ"), n))
    some = [(k, word(int(rng.integers(1, 5)))) for k in range(40)] + [(41, "ab"), (42, "AB"), (43, ""), (44, None), (45, "(.*"), (45, "b")]
    texts = [(k, word(int(rng.integers(0, 60))), word(10)) for k in range(60)] + [(90, None, "x(.*y"), (91, "", "ab"), (91, "", "ab")]
    frame = spark.createDataFrame
    got = patterns.find(frame(texts, "m long, s string, b string"), "m", ["s", "b"], frame(some, "pattern_id long, pattern string"), alone, held=held).collect()

    def held_in(p, t):
        if not alone:
            return p in t
        return any((m.start() == 0 or not re.match("[a-z0-9]", t[m.start() - 1])) and not re.match("[a-z0-9]", t[m.start() + len(p) :][:1] or " ") for m in re.finditer(f"(?={re.escape(p)})", t))

    want = {(k, f, i) for k, s, b in texts for f, t in (("s", s), ("b", b)) if t is not None for i, p in some if p and held_in(p.lower(), t.lower())}
    assert {tuple(r) for r in got} == want and len(want) > 50


def test_evidence_of_each_field(spark):
    frame = spark.createDataFrame
    mail = frame([(1, "P-12 north", "north P-12b", "P-12.pdf"), (2, "NORTH", None, "")], "message_id long, subject string, body string, filename string")
    p = frame([(7, "p-12", "North"), (8, "", None)], "project_id long, code string, name string")
    codes = messages.link_by_code(mail, p, {"subject": "code_subject", "body": "code_body", "filename": "code_attachment"})
    assert sorted((r.message_id, r.project_id, r.source, r.confidence) for r in codes.collect()) == [(1, 7, "code_attachment", 90), (1, 7, "code_subject", 90)]
    names = messages.link_by_name(mail, p, ["subject", "body"])
    assert sorted((r.message_id, r.project_id, r.source) for r in names.collect()) == [(1, 7, "name"), (1, 7, "name"), (2, 7, "name")]
    found = messages.combine_evidence(codes.unionByName(names)).collect()
    assert {(r.message_id, r.source, r.n_evidence, r.confidence, r.band) for r in found} == {(1, "code_attachment", 4, 99, "exact"), (2, "name", 1, 75, "medium")}


def test_texts_are_read_once(spark):
    """More patterns than a task holds don't make the texts be read more often, and the result stays the same."""
    frame = spark.createDataFrame
    texts = frame([(k, f"north {k}-a, {k + 1}x {k + 2}") for k in range(300)], "m long, s string")
    some = frame([(k, f"{k}-A" if k % 3 == 0 else str(k)) for k in range(400)], "pattern_id long, pattern string")
    got, want = (patterns.find(texts, "m", ["s"], some, True, held=h) for h in (100, None))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one for the texts, one for the patterns


def test_places_across_pieces(monkeypatch):
    monkeypatch.setattr(patterns, "LETTERS", 7)
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab1 Õ\U0001f600\x00"), int(rng.integers(0, 60)))) for _ in range(200)] + ["ab" * 60]
    own = {t[i : i + n] for t in texts for i in (0, 3, 11) for n in (1, 2, 3, 5, 9, 70, 100)} - {""}
    lengths = {}
    for n in {len(p) for p in own}:
        lengths.setdefault(patterns._end(n), []).append(n)
    bitmap = np.zeros((1 << patterns.BITS) // 8, np.uint8)
    for b in patterns._bits(own):
        bitmap[b >> 3] |= 1 << (b & 7)
    got = patterns._candidates(texts, bitmap, lengths, False)
    want = {(i, p) for i, t in enumerate(texts) for p in own if p in t}
    assert {x for x in got if x[1] in own} == want and len(got) < 1.01 * len(want)
