"""Candidates in messages against a plain version of the rules."""

import datetime as dt
import re
from collections import Counter

from pyspark.sql import functions as F
from tallyspark.functions.text import clean_body
from tallyspark.operators import messages
from tallyspark.plans.queries import mail

RULES = {
    ("question", 80): "?|kas |palun kinnitage|please confirm|can you|could you",
    ("task_request", 75): "palun saada|palun saatke|please provide|please send|vajame|please prepare",
    ("commitment", 75): "saadan|teen |we will provide|i will send|we will send|i will provide",
    ("decision", 70): "kinnitatud|approved|otsustasime|we agreed",
    ("risk", 65): "risk|oht|may delay|delay risk|might not",
    ("blocker", 70): "blocked|blocker|takistus|ei saa jätkata|cannot continue",
    ("resolution_evidence", 60): "resolved|done|completed|vastatud|lahendatud",
}
AT = dt.date(2026, 7, 15)  # a Wednesday
DATED = {"due 2026-07-20": dt.date(2026, 7, 20), "x2026-07-20": None, "2026-02-30": None, "see you tomorrow": dt.date(2026, 7, 16), "homme": dt.date(2026, 7, 16), "by Wednesday": dt.date(2026, 7, 22), "by Friday": dt.date(2026, 7, 17), "by Monday": dt.date(2026, 7, 20), "on Monday": None}


def plain_date(low, at):
    if m := re.search(r"\b(20\d{2})-(\d{2})-(\d{2})\b", low):
        try:
            return dt.date(*map(int, m.groups()))
        except ValueError:
            return None
    if "tomorrow" in low or "homme" in low:
        return at + dt.timedelta(1)
    for k, day in enumerate("monday tuesday wednesday thursday friday".split()):
        if f"by {day}" in low:
            return at + dt.timedelta((k - at.weekday()) % 7 or 7)


def plain(subject, body, at):
    text, start = "\n".join(x for x in (subject, body) if x).strip(" "), 0
    out = []
    for part in re.findall(r"[^.?!\n]*[.?!\n]|[^.?!\n]+", text):
        low, s, e = part.strip().lower(), start, start + len(part)
        start, due = e, plain_date(low, at)
        for (kind, sure), marks in RULES.items():
            if low and any(m in low for m in marks.split("|")):
                out.append((kind, s, e, sure, part.strip(), due if kind in ("task_request", "commitment") else None))
        if due:
            out.append(("deadline", s, e, 65, part.strip(), due))
    if not out and any(m in text.lower() for m in ("for your information", "fyi", "infoks", "teadmiseks")):
        out.append(("information_only", 0, min(len(text), 240), 40, text[:240], None))
    return out


def test_every_mark_and_date(spark):
    marks = [m for v in RULES.values() for m in v.split("|")] + ["infoks", "FYI, for your information", "nothing"]
    bodies = [f"Before. Now {m} that\nAfter" for m in marks] + [f"Well, {d}! I will send it {d}." for d in DATED] + ["What??", "Ready?  Approved.\n\nBlocked"]
    rows = [(i, "RE: Risk" if i % 3 == 0 else None, b, AT) for i, b in enumerate(bodies)]
    got = messages.extract(spark.createDataFrame(rows, "message_id long, subject string, body string, at date")).collect()
    want = Counter((i, *x) for i, s, b, at in rows for x in plain(s, re.sub("\n+", "\n", b), at))
    assert Counter(map(tuple, got)) == want
    for k, (d, due) in enumerate(DATED.items(), len(marks)):
        assert {r.due_date for r in got if r.message_id == k and r.kind == "deadline"} == ({due} if due else set()), d


def test_on_documents(spark):
    m = mail(spark, "/root/testdata/sf0.001").withColumn("at", F.lit(AT))
    rows = m.select("message_id", "subject", clean_body(F.col("body")).alias("body")).collect()
    got = Counter(map(tuple, messages.extract(m).collect()))
    assert got == Counter((r.message_id, *x) for r in rows for x in plain(r.subject, r.body, AT)) and got


def test_marks_are_looked_for_once(spark):
    """A sentence's lower case is worked out in one place, and where a long text's sentences start is not summed part by part."""
    body = "".join(f"Line {i} ok.{' ' * (i % 3)}\n" for i in range(700)) + "Approved? Fyi"
    rows = spark.createDataFrame([(1, body, AT)], "message_id long, body string, at date")
    df = messages.extract(rows)
    got = Counter(map(tuple, df.collect()))
    assert got == Counter((1, *x) for x in plain(None, re.sub(r" +\n", "\n", body), AT)) and got
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("lower(") <= 12, plan.count("lower(")
