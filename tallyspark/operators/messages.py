"""Project correspondence: linking messages to projects, evidence, extraction of candidates, threads and timelines."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import let
from ..functions.text import clean_body, confidence_band, sentences
from .patterns import find

# The marks of each kind of candidate and how sure the kind is. A deadline is a sentence with a date.
LEXICON = [
    ("question", 80, ("?", "kas ", "palun kinnitage", "please confirm", "can you", "could you")),
    ("task_request", 75, ("palun saada", "palun saatke", "please provide", "please send", "vajame", "please prepare")),
    ("commitment", 75, ("saadan", "teen ", "we will provide", "i will send", "we will send", "i will provide")),
    ("decision", 70, ("kinnitatud", "approved", "otsustasime", "we agreed")),
    ("risk", 65, ("risk", "oht", "may delay", "delay risk", "might not")),
    ("blocker", 70, ("blocked", "blocker", "takistus", "ei saa jätkata", "cannot continue")),
    ("resolution_evidence", 60, ("resolved", "done", "completed", "vastatud", "lahendatud")),
]
DEADLINE, INFORMATION = 65, (40, ("for your information", "fyi", "infoks", "teadmiseks"))
QUESTION_WORDS = {"estonian_keyword": ("kas", "millal", "miks", "kuidas", "palun", "kinnitage", "saatke"), "english_keyword": ("can you", "could you", "please", "confirm", "when", "why", "how")}
TOMORROW, WEEKDAYS = ("tomorrow", "homme"), ("monday", "tuesday", "wednesday", "thursday", "friday")


# How sure a source is and where it ranks.
CONFIDENCE = {"code_subject": 90, "code_body": 90, "code_attachment": 90, "document": 80, "name": 75, "thread": 70, "participant": 5}
RANKS = {"user": 1, "legacy": 1, "code_subject": 2, "code_attachment": 2, "document": 3, "code_body": 4, "thread": 5, "name": 6, "participant": 7, "backfill": 8}


def evidence(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("message_id", "project_id", F.lit(source).alias("source"), F.lit(CONFIDENCE[source]).alias("confidence")).distinct()


def _found(hits: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Evidence of what patterns.find() found, a piece for each field."""
    table = lambda of: F.create_map(*(F.lit(x) for kv in of.items() for x in kv))
    source = F.element_at(table(sources), F.col("field"))
    return hits.select("message_id", F.col("pattern_id").alias("project_id"), source.alias("source"), F.element_at(table(CONFIDENCE), source).alias("confidence"))


def link_by_code(messages: DataFrame, projects: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Messages of which a field holds a project's code by itself: no letter or digit on either side. sources: what a field's
    evidence is called."""
    codes = projects.select(F.col("project_id").alias("pattern_id"), F.col("code").alias("pattern"))
    return _found(find(messages, "message_id", list(sources), codes, alone=True), sources)


def normal_text(x: str) -> str:
    """Compatibility forms composed, tags and repeated white space gone, case folded."""
    return " ".join(re.sub(r"<[^>]+>", " ", unicodedata.normalize("NFKC", x)).split()).casefold()


def link_by_name(messages: DataFrame, projects: DataFrame, fields: list[str]) -> DataFrame:
    """Messages of which a field holds a project's name, inside words too; a piece of evidence for each field."""
    names = projects.select(F.col("project_id").alias("pattern_id"), F.col("name").alias("pattern"))
    return _found(find(messages, "message_id", fields, names, normal=normal_text), dict.fromkeys(fields, "name"))


def link_by_document(attachments: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Messages with a document that other messages have, of whose confirmed links there is exactly one.

    attachments(message_id, document_id), confirmed(message_id, project_id). A document's links are counted once for all its
    messages, so a document that very many share needs no pairs of messages.
    """
    a = attachments.where("document_id is not null").distinct()
    links = a.join(confirmed, "message_id").groupBy("document_id").agg(F.count("*").alias("n"), F.first("project_id").alias("project_id"), F.sum("project_id").alias("s"))
    own = a.join(confirmed, "message_id").groupBy("document_id", "message_id").agg(F.count("*").alias("mine"), F.sum("project_id").alias("sum"))
    both = a.join(links, "document_id").join(own, ["document_id", "message_id"], "left")
    rest = both.where(F.col("n") - F.coalesce("mine", F.lit(0)) == 1)
    return evidence(rest.withColumn("project_id", F.col("s") - F.coalesce("sum", F.lit(0))), "document")


def participants(sender: str, *lists: str):
    """Distinct addresses of sender and receivers, case folded."""
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(sender), *(F.coalesce(c, F.array().cast("array<string>")) for c in lists)), lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x, F.lit("")) != ""))


def boost_participants(found: DataFrame, messages: DataFrame, parties: DataFrame) -> DataFrame:
    """A piece of evidence for each active party of an already found project that takes part in the message."""
    p = messages.select("message_id", F.explode("participants").alias("email"))
    mine = found.select("message_id", "project_id").distinct().join(p, "message_id")
    at = parties.where("is_active").select("project_id", F.lower("email").alias("email"))
    return mine.join(at, ["project_id", "email"]).select("message_id", "project_id", F.lit("participant").alias("source"), F.lit(CONFIDENCE["participant"]).alias("confidence"))


def link_by_thread(messages: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Messages whose thread's other messages have confirmed links to exactly one project."""
    c = messages.select("message_id", "thread_id").join(confirmed, "message_id")
    of = c.groupBy("thread_id").agg(F.collect_set("project_id").alias("all"))
    few = of.where(F.size("all") <= 2)  # with three projects or more no other message's can be one
    counts = c.groupBy("thread_id", "project_id").agg(F.count_distinct("message_id").alias("n"))
    own = c.groupBy("message_id").agg(F.collect_set("project_id").alias("own"))
    rows = messages.select("message_id", "thread_id").join(few, "thread_id").join(own, "message_id", "left").select("message_id", "thread_id", "own", F.explode("all").alias("project_id"))
    left = rows.join(counts, ["thread_id", "project_id"]).where(F.col("n") - F.coalesce(F.array_contains("own", F.col("project_id")), F.lit(False)).cast("int") > 0)
    one = left.groupBy("message_id").agg(F.count("*").alias("k"), F.first("project_id").alias("project_id")).where("k = 1")
    return evidence(one, "thread")


def questions(messages: DataFrame, fields: list[str]) -> DataFrame:
    """(message_id, field, rule, keyword, confidence): what makes a message a question."""
    rows = []
    for f in fields:
        rows.append(F.when(F.col(f).contains("?"), F.struct(F.lit(f).alias("field"), F.lit("question_mark").alias("rule"), F.lit("").alias("keyword"), F.lit(70).alias("confidence"))))
        for rule, words in QUESTION_WORDS.items():
            rows += [F.when(F.lower(f).contains(w), F.struct(F.lit(f).alias("field"), F.lit(rule).alias("rule"), F.lit(w).alias("keyword"), F.lit(60).alias("confidence"))) for w in words]
    return messages.select("message_id", F.explode(F.array_compact(F.array(*rows))).alias("q")).select("message_id", "q.*")


def combine_evidence(evidence: DataFrame) -> DataFrame:
    """A link for each message and project: min(100, best + 3 for each further piece), band, source by rank, conflict flag."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv)), F.col("source")), F.lit(99))
    first = F.struct(rank, -F.col("confidence"), F.col("source"))
    g = evidence.groupBy("message_id", "project_id").agg(F.max("confidence").alias("best"), F.count("*").alias("n_evidence"), F.min_by("source", first).alias("source"))
    g = g.withColumn("confidence", F.least(F.lit(100), F.col("best") + 3 * (F.col("n_evidence") - 1)))
    n = g.groupBy("message_id").agg(F.count("*").alias("_n"))
    return g.join(n, "message_id").select("message_id", "project_id", "source", "n_evidence", F.col("confidence").cast("int").alias("confidence"), confidence_band(F.col("confidence")).alias("band"), (F.col("_n") > 1).alias("conflict"))


def primary_link(links: DataFrame) -> DataFrame:
    """Confirmed first, then the surest, then the smallest project."""
    order = W.partitionBy("message_id").orderBy(F.desc(F.col("status") == "confirmed"), F.desc("confidence"), "project_id")
    return links.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def persist_suggestions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Suggested links are refreshed; confirmed, rejected, corrected and superseded ones are left alone."""
    f = fresh.select("message_id", "project_id", F.col("confidence").alias("_c"))
    both = stored.join(f, ["message_id", "project_id"], "full_outer")
    frozen = F.col("status").isin("confirmed", "rejected", "corrected", "superseded")
    action = F.when(F.col("status").isNull(), "created").when(frozen & F.col("_c").isNotNull(), "skipped").when(F.col("_c").isNull() | (F.col("_c") == F.col("confidence")), "unchanged").otherwise("updated")
    return both.select("message_id", "project_id", F.coalesce("status", F.lit("suggested")).alias("status"), F.when(frozen, F.col("confidence")).otherwise(F.coalesce("_c", "confidence")).alias("confidence"), action.alias("action"))


def _any(c, marks):
    return c.rlike("|".join(map(re.escape, marks)))  # one call: many of contains make generated code too long to be compiled


def due_date(low, at):
    """The date that a sentence in lower case names: written out, or else tomorrow or the next such weekday after `at`."""
    written = lambda pattern: F.when(low.contains("20"), F.regexp_extract(low, rf"(?U)\b({pattern})\b", 1)).otherwise("")
    iso, local = written("20[0-9]{2}-[0-9]{2}-[0-9]{2}"), written(r"[0-9]{1,2}\.[0-9]{1,2}\.20[0-9]{2}")
    out = F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when(local != "", F.try_to_date(local, "d.M.yyyy")).when(_any(low, TOMORROW), F.date_add(at, 1))
    for k, name in enumerate(WEEKDAYS):
        out = out.when(low.contains(f"by {name}"), F.date_add(at, (F.pmod(F.lit(k - 1) - F.weekday(at), F.lit(7)) + 1).cast("int")))
    return out


def extract(messages: DataFrame, text: str = "body") -> DataFrame:
    """(message_id, kind, start, end, confidence, excerpt, due_date): for each sentence the kinds that it has a mark of.

    The text is the subject, where there is one, and the cleaned body on the next line. Dates relative to the message need
    its date in a column `at`; an impossible date is none. A message without any candidate may be for information only.
    A sentence's lower case is worked out once, in the array of sentences: of a column, each mark would do it again. Only
    sentences that may hold a mark or a date become rows.
    """
    own = lambda c, kind: F.col(c) if c in messages.columns else F.lit(None).cast(kind)
    parts = F.array(own("subject", "string"), clean_body(F.col(text)))
    m = messages.select("message_id", F.trim(F.array_join(F.filter(parts, lambda x: x != ""), "\n")).alias("t"), own("at", "date").cast("date").alias("at"))
    marks = [x for _, _, own in LEXICON for x in own]
    marked = lambda low: _any(low, marks)
    sentence = lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["text"]).alias("low"))
    maybe = F.array(*(F.lit(x) for x in [*marks, "20", *TOMORROW, *(f"by {x}" for x in WEEKDAYS)]))
    some = lambda held: F.when(F.size(held) > 0, F.filter(F.transform(sentences(F.col("t")), sentence), lambda s: F.exists(held, lambda x: s["low"].contains(x))))

    # a message for information only is a row of its first letters in place of its sentences
    m = m.withColumn("s", let(let(F.lower("t"), lambda low: F.filter(maybe, lambda x: low.contains(x))), some))
    m = m.select("message_id", "at", "t", "s", _any(F.lower("t"), INFORMATION[1]).alias("info"))
    plain = ~F.coalesce(F.exists("s", lambda s: marked(s["low"]) | due_date(s["low"], F.col("at")).isNotNull()), F.lit(False))
    head = F.struct(F.substring("t", 1, 240).alias("text"), F.lit(0).alias("start"), F.least(F.length("t"), F.lit(240)).alias("end"), F.lit("").alias("low"))
    m = m.select("message_id", "at", "s", F.when(F.col("info") & plain, head).alias("head"))
    rows = m.select("message_id", "at", F.col("head").isNotNull().alias("info"), F.explode(F.when(F.col("head").isNotNull(), F.array("head")).otherwise(F.col("s"))).alias("s"))
    dated = rows.select("message_id", "at", "info", "s.*").withColumn("due", F.when(~F.col("info"), due_date(F.col("low"), F.col("at"))))
    hits = dated.where(F.col("info") | F.col("due").isNotNull() | marked(F.col("low")))

    none = F.lit(None).cast("date")
    row = lambda kind, confidence, due: F.struct(F.lit(kind).alias("kind"), "start", "end", F.lit(confidence).alias("confidence"), F.col("text").alias("excerpt"), due.alias("due_date"))
    found = [F.when(_any(F.col("low"), marks), row(kind, c, F.col("due") if kind in ("task_request", "commitment") else none)) for kind, c, marks in LEXICON]
    kinds = F.array_compact(F.array(*found, F.when(F.col("due").isNotNull(), row("deadline", DEADLINE, F.col("due")))))
    kinds = F.when(F.col("info"), F.array(row("information_only", INFORMATION[0], none))).otherwise(kinds)
    return hits.select("message_id", F.explode(kinds).alias("c")).select("message_id", "c.*")


def thread_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.max("at").alias("last_at"), F.countDistinct("sender").alias("n_senders"))


def timeline(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """Rows (kind, id, at) of all kinds in one table, numbered by time, then kind and id, within each subject."""
    out = None
    for name, df in kinds:
        part = df.select("subject", F.lit(name).alias("kind"), "id", "at")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("position", F.row_number().over(W.partitionBy("subject").orderBy("at", "kind", "id")))


def review_summary(rows: DataFrame, today) -> DataFrame:
    """One row of counts over candidates(kind, status, band, snoozed_until, reviewed_at) and the approval rate in whole percent."""
    day, is_ = F.lit(today).cast("date"), lambda c, *v: F.col(c).isin(*v)
    n = {
        "pending": is_("status", "pending_review"),
        "high_confidence": is_("status", "pending_review") & is_("band", "high"),
        "questions": is_("kind", "question"),
        "task_requests": is_("kind", "task_request"),
        "commitments": is_("kind", "commitment"),
        "decisions": is_("kind", "decision"),
        "risks_blockers": is_("kind", "risk", "blocker"),
        "snoozed": F.coalesce(F.col("snoozed_until") > day, F.lit(False)),
        "reviewed_today": F.coalesce(F.to_date("reviewed_at") == day, F.lit(False)),
        "approved": is_("status", "approved", "edited_and_approved"),
        "reviewed": ~is_("status", "pending_review"),
    }
    g = rows.agg(*(F.count_if(c).alias(k) for k, c in n.items()))
    return g.withColumn("approval_rate", F.when(F.col("reviewed") > 0, F.bround(F.col("approved").cast("double") / F.col("reviewed") * 100, 0)).otherwise(0.0))
