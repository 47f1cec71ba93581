"""The ledger queries over the driver's tables, each with its SQL; every query runs over its whole tables."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import dates as D, fingerprint as FP, numeric as N, text as T
from ..operators import ledger, matching, messages as M, upsert
from ..sources import adapters as A
from ..sources.shared import shared_dir, written
from ..streaming import state
from . import allocations, changes, finance, mailboxes, match, outer, text_fields, upkeep  # noqa: F401
from .registry import QUERIES, SQL, doubles, query  # noqa: F401

def dimensions(spark, d):
    return A.table(spark, d, "supplier").select(F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("external_id"), (10000 + F.col("s_suppkey") * 20).cast("string").alias("code"))


def pulled(spark, d):
    """The dimensions as pulled anew: a third gone, some codes moved, some ids new, one code twice."""
    k = A.table(spark, d, "supplier").where("s_suppkey % 3 <> 0")
    return k.select(F.concat(F.when(F.col("s_suppkey") % 5 == 0, "N").otherwise("D"), F.col("s_suppkey").cast("string")).alias("external_id"), (10000 + F.when(F.col("s_suppkey") % 7 == 0, F.col("s_suppkey") + 1).otherwise(F.col("s_suppkey")) * 20).cast("string").alias("code"))


DIMENSIONS = """, dims AS (SELECT 'D' || s_suppkey external_id, CAST(10000 + s_suppkey * 20 AS VARCHAR) code FROM supplier),
pulled AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'N' ELSE 'D' END || s_suppkey external_id, CAST(10000 + CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey + 1 ELSE s_suppkey END * 20 AS VARCHAR) code FROM supplier WHERE s_suppkey % 3 <> 0)"""


@query("j5_dimension_coverage", DIMENSIONS + " SELECT coalesce(p.code, q.code) code, CASE WHEN p.code IS NOT NULL AND q.code IS NOT NULL THEN 'linked' WHEN q.code IS NOT NULL THEN 'missing' ELSE 'workspace_only' END state FROM projects p FULL JOIN dims q ON p.code = q.code")
def j5(spark, d):
    return ledger.dimension_coverage(A.projects(spark, d), dimensions(spark, d))


@query("j27_dimension_conflicts", DIMENSIONS + """ SELECT external_id, code, 'duplicate_code' kind FROM pulled WHERE code IN (SELECT code FROM pulled GROUP BY code HAVING count(*) > 1)
UNION SELECT i.external_id, i.code, 'code_of_other_id' FROM pulled i JOIN dims s ON i.code = s.code WHERE i.external_id <> s.external_id
UNION SELECT i.external_id, i.code, 'id_of_other_code' FROM pulled i JOIN dims s ON i.external_id = s.external_id WHERE i.code <> s.code""")
def j27(spark, d):
    return upsert.conflicts(pulled(spark, d), dimensions(spark, d))


@query("j28_archived_dimensions", DIMENSIONS + " SELECT code, external_id FROM dims s WHERE external_id NOT IN (SELECT external_id FROM pulled) AND code NOT IN (SELECT code FROM pulled)")
def j28(spark, d):
    return upsert.archived(dimensions(spark, d), pulled(spark, d))


@query("m1_upsert_actions", DIMENSIONS + " SELECT coalesce(s.external_id, i.external_id) external_id, CASE WHEN s.external_id IS NULL THEN 'created' WHEN i.external_id IS NULL THEN 'absent' WHEN s.code = i.code THEN 'unchanged' ELSE 'updated' END AS action, coalesce(i.code, s.code) code FROM dims s FULL JOIN pulled i ON s.external_id = i.external_id")
def m1(spark, d):
    return upsert.diff(dimensions(spark, d), pulled(spark, d), "external_id", ["code"])


@query("m6_bank_fingerprints", "SELECT sha256(CAST(amount AS VARCHAR) || '|' || party || '|' || remittance || '|' || CAST(booking_date AS VARCHAR)) fingerprint, count(*) seen_count, CAST(any_value(amount) AS DOUBLE) amount, any_value(party) party, any_value(remittance) remittance, any_value(booking_date) booking_date FROM (SELECT * REPLACE (CAST(amount AS DECIMAL(20,2)) AS amount) FROM bank) GROUP BY 1")
def m6(spark, d):
    return doubles(upsert.seen_counts(A.bank(spark, d), ["amount", "party", "remittance", "booking_date"]))


@query("m7_filled_merge", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'new ' || c_custkey END AS name FROM customer", False)
def m7(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return upsert.merge_filled(c, c.select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("new "), F.col("id").cast("string"))).alias("name")), "id", ["name"])


@query("m10_latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events) WHERE n = 1", False)
def m10(spark, d):
    return upsert.latest(A.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.desc("ts"), F.desc("event_id")).drop("ts")


@query("merge_roots", "WITH RECURSIVE l AS (SELECT c_custkey node, c_custkey // 3 AS into_ FROM customer WHERE c_custkey >= 3), r AS (SELECT node, into_ AS root FROM l UNION ALL SELECT r.node, l.into_ FROM r JOIN l ON r.root = l.node) SELECT node, min(root) root, false AS cyclic FROM r GROUP BY node", False)
def u9(spark, d):
    return upsert.merge_roots(A.table(spark, d, "customer").where("c_custkey >= 3").select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 3").alias("into")))


@query("w1_keep_best", "SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) > 1 AS is_duplicate FROM documents", False)
def w1(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("key"))
    return matching.keep_best(rows, "key", F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "is_duplicate")


# Correspondence: documents as messages; a project's code stands in some of them, benchmark items are names.
NAME = "concat('Customer#', lpad(CAST(doc_id % 90 + 1 AS STRING), 9, '0'))"
MAIL = f"""doc_id AS message_id, concat(CASE WHEN doc_id % 3 = 0 THEN concat('[', 10000 + doc_id % 150 + 1, '] ', source) ELSE concat('RE: Fwd: ', source) END, CASE WHEN doc_id % 16 = 11 THEN concat(' <b>', {NAME}, '</b>') ELSE '' END) AS subject,
 CASE WHEN doc_id % 4 = 0 THEN concat(text, ' objekt ', 10000 + doc_id % 70 + 1, '-A.') WHEN doc_id % 8 = 3 THEN concat(text, ' tellija ', {NAME}, 'le') ELSE text END AS body, doc_id // 5 AS thread_id,
 CASE WHEN doc_id % 6 < 2 THEN doc_id // 6 END AS document_id, CASE WHEN doc_id % 7 = 0 THEN concat('plan_', 10000 + doc_id % 30 + 1, '.pdf') ELSE '' END AS filename, concat('P', (doc_id % 150 + 1) % 40, '@x.ee') AS sender"""
MESSAGES = f"SELECT {MAIL} FROM documents".replace("AS STRING", "AS VARCHAR")


def mail(spark, d):
    exprs = text_fields._split(MAIL.replace("//", "div"))
    return A.table(spark, d, "documents").selectExpr(*exprs)


def coded(spark, d):
    """Projects whose code holds a mark in one case of three."""
    return A.projects(spark, d).withColumn("code", F.when(F.col("project_id") % 3 == 0, F.concat("code", F.lit("-A"))).otherwise(F.col("code")))


def parties(spark, d):
    return A.projects(spark, d).selectExpr("project_id", "concat('p', project_id % 40, '@X.ee') AS email", "project_id % 5 <> 0 AS is_active")


def codes(spark, d) -> DataFrame:
    return M.link_by_code(mail(spark, d), coded(spark, d), {"subject": "code_subject", "body": "code_body", "filename": "code_attachment"})


def confirmed(found: DataFrame) -> DataFrame:
    """Links by a code in the subject stand for those that someone has confirmed."""
    return found.where("source = 'code_subject'").select("message_id", "project_id").distinct()


def links(spark, d):
    """All evidence: codes, names, threads, documents, and participants in what these find."""
    m, p = mail(spark, d), coded(spark, d)
    by_code = written(codes(spark, d), "codes")
    sure = confirmed(by_code)
    found = by_code.unionByName(M.link_by_name(m, p, ["subject", "body"]))
    found = found.unionByName(M.link_by_thread(m.select("message_id", "thread_id"), sure)).unionByName(M.link_by_document(m.select("message_id", "document_id"), sure))
    found = written(found, "evidence")
    who = m.select("message_id", M.participants("sender").alias("participants"))
    return found.unionByName(M.boost_participants(found, who, parties(spark, d)))


HELD = "regexp_matches(lower({0}), '(^|[^a-z0-9])' || code || '([^a-z0-9]|$)')"
CODES = f"""mail AS ({MESSAGES}), own_codes AS (SELECT project_id, CASE WHEN project_id % 3 = 0 THEN lower(code) || '-a' ELSE lower(code) END code FROM projects),
texts AS (SELECT message_id, 'code_subject' AS source, lower(subject) t FROM mail UNION ALL SELECT message_id, 'code_body', lower(body) FROM mail UNION ALL SELECT message_id, 'code_attachment', lower(filename) FROM mail),
runs AS (SELECT message_id, source, t, unnest(list_filter(list_distinct(string_split_regex(t, '[^a-z0-9]+')), lambda x: regexp_matches(x, '^[0-9]+$'))) AS run FROM texts),
found AS (SELECT message_id, project_id, source, 90 confidence FROM runs JOIN own_codes ON run = split_part(code, '-', 1) AND {HELD.format("t")}),
confirmed AS (SELECT DISTINCT message_id, project_id FROM found WHERE source = 'code_subject'),
threads AS (SELECT m.message_id, min(c.project_id) project_id, 'thread' AS source, 70 confidence FROM mail m JOIN mail o ON o.thread_id = m.thread_id AND o.message_id <> m.message_id JOIN confirmed c ON c.message_id = o.message_id GROUP BY m.message_id HAVING count(DISTINCT c.project_id) = 1),
documented AS (SELECT m.message_id, min(c.project_id) project_id, 'document' AS source, 80 confidence FROM mail m JOIN mail o ON o.document_id = m.document_id AND o.message_id <> m.message_id JOIN confirmed c ON c.message_id = o.message_id GROUP BY m.message_id HAVING count(*) = 1),
named AS (SELECT message_id, project_id, 'name' AS source, 75 confidence FROM (SELECT message_id, unnest(list_distinct(regexp_extract_all(lower(t), 'customer#[0-9]{{9}}'))) n FROM mail, unnest([subject, body]) AS f(t)) JOIN projects ON lower(name) = n),
pieces AS (SELECT * FROM found UNION ALL SELECT * FROM named UNION ALL SELECT * FROM threads UNION ALL SELECT * FROM documented),
boosted AS (SELECT * FROM pieces UNION ALL SELECT f.message_id, f.project_id, 'participant', 5 FROM (SELECT DISTINCT message_id, project_id FROM pieces) f JOIN mail m USING (message_id) JOIN projects p ON p.project_id = f.project_id WHERE p.project_id % 5 <> 0 AND lower(m.sender) = lower('p' || (p.project_id % 40) || '@X.ee'))"""


@query("j17_links_by_code", f", {CODES} SELECT * FROM found")
def j17(spark, d):
    return codes(spark, d)


@query("j22_participant_evidence", f", {CODES} SELECT * FROM boosted WHERE source = 'participant'")
def j22(spark, d):
    return links(spark, d).where("source = 'participant'")


NAMED = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(
    "j18_links_by_name",
    f"""WITH names AS (SELECT item_id project_id, CASE WHEN item_id % 3 = 0 THEN string_split({NAMED.format("text")}, ' ')[1] ELSE {NAMED.format("text")} END n FROM benchmark),
docs AS (SELECT doc_id message_id, {NAMED.format("regexp_replace(f.t, '<[^>]+>', ' ', 'g')")} t FROM documents, unnest([concat(source, ' ', text[1:40]), text]) AS f(t))
SELECT message_id, project_id, 'name' AS source, 75 confidence FROM docs JOIN names ON contains(t, n) WHERE n <> ''""",
    False,
)
def j18(spark, d):
    """Whole benchmark items as names, and of one in three its first word alone; a source and the first 40 letters are
    the subject."""
    name = F.when(F.col("item_id") % 3 == 0, F.get(F.split(F.trim("text"), r"\s+"), 0)).otherwise(F.col("text"))
    names = A.table(spark, d, "benchmark").select(F.col("item_id").alias("project_id"), name.alias("name"))
    m = A.table(spark, d, "documents").select(F.col("doc_id").alias("message_id"), F.concat("source", F.lit(" "), F.substring("text", 1, 40)).alias("subject"), F.col("text").alias("body"))
    return M.link_by_name(m, names, ["subject", "body"])


COMBINED = f"""{CODES}, g AS (SELECT message_id, project_id, max(confidence) best, count(*) n_evidence, arg_min(source, (CASE source WHEN 'code_subject' THEN 2 WHEN 'code_attachment' THEN 2 WHEN 'document' THEN 3 WHEN 'code_body' THEN 4 WHEN 'thread' THEN 5 WHEN 'name' THEN 6 ELSE 7 END, -confidence, source)) AS source FROM boosted GROUP BY 1, 2),
c AS (SELECT message_id, project_id, source, n_evidence, least(100, best + 3 * (n_evidence - 1))::INTEGER confidence FROM g),
combined AS (SELECT *, CASE WHEN confidence >= 95 THEN 'exact' WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END band, count(*) OVER (PARTITION BY message_id) > 1 AS conflict FROM c)"""


@query("w8_combined_evidence", f", {COMBINED} SELECT * FROM combined")
def w8(spark, d):
    return M.combine_evidence(links(spark, d))


@query("w5_primary_links", f", {COMBINED} SELECT message_id, project_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY project_id % 4 = 0 DESC, confidence DESC, project_id) k FROM combined) WHERE k = 1")
def w5(spark, d):
    rows = w8(spark, d).withColumn("status", F.when(F.col("project_id") % 4 == 0, "confirmed").otherwise("suggested"))
    return M.primary_link(rows).select("message_id", "project_id", "confidence")


@query("j19_thread_inheritance", f", {CODES} SELECT * FROM threads")
def j19(spark, d):
    return M.link_by_thread(mail(spark, d).select("message_id", "thread_id"), confirmed(codes(spark, d)))


@query("j20_document_inheritance", f", {CODES} SELECT * FROM documented")
def j20(spark, d):
    return M.link_by_document(mail(spark, d).select("message_id", "document_id"), confirmed(codes(spark, d)))


@query("m11_persisted_suggestions", f""", {COMBINED}, stored AS (SELECT message_id, project_id, CASE message_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'suggested' END status, CASE WHEN message_id % 2 = 0 THEN confidence ELSE 70 END confidence FROM combined WHERE message_id % 5 <> 0)
SELECT h.message_id, h.project_id, coalesce(status, 'suggested') status, CASE WHEN status IN ('confirmed', 'rejected') THEN s.confidence ELSE h.confidence END confidence, CASE WHEN status IS NULL THEN 'created' WHEN status IN ('confirmed', 'rejected') THEN 'skipped' WHEN h.confidence = s.confidence THEN 'unchanged' ELSE 'updated' END AS action
FROM combined h LEFT JOIN stored s ON s.message_id = h.message_id AND s.project_id = h.project_id""")
def m11(spark, d):
    hits, k = w8(spark, d), F.col("message_id")
    stored = hits.where("message_id % 5 <> 0").select("message_id", "project_id", F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "rejected").otherwise("suggested").alias("status"), F.when(k % 2 == 0, F.col("confidence")).otherwise(70).alias("confidence"))
    return M.persist_suggestions(stored, hits)


WORDS = [(f, r, w) for f in ("subject", "body") for r, ws in M.QUESTION_WORDS.items() for w in ws]


@query("t25_question_evidence", f"WITH mail AS ({MESSAGES}), " + "q AS (" + " UNION ALL ".join([f"SELECT message_id, '{f}' field, 'question_mark' \"rule\", '' keyword, 70 confidence FROM mail WHERE contains({f}, '?')" for f in ("subject", "body")] + [f"SELECT message_id, '{f}', '{r}', '{w}', 60 FROM mail WHERE contains(lower({f}), '{w}')" for f, r, w in WORDS]) + ") SELECT * FROM q", False)
def t25(spark, d):
    return M.questions(mail(spark, d), ["subject", "body"])


@query("t22_languages", f"WITH mail AS ({MESSAGES}) SELECT message_id, CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in T.ESTONIAN) + " THEN 'et' WHEN " + " OR ".join(f"contains(t, '{w}')" for w in T.ENGLISH) + " THEN 'en' ELSE 'unknown' END lang FROM (SELECT message_id, lower(subject || ' ' || body) t FROM mail)", False)
def t22(spark, d):
    return mail(spark, d).select("message_id", T.guess_language(F.col("subject"), F.col("body")).alias("lang"))


@query("t21_clean_bodies", f"""WITH mail AS ({MESSAGES}), l AS (SELECT message_id, list_transform(string_split(body || chr(10) || CASE message_id % 3 WHEN 0 THEN '> quoted' || chr(10) || 'From: me' || chr(10) || 'kept' || chr(10) || 'Best regards' || chr(10) || 'gone' ELSE ' ' END, chr(10)), lambda x: trim(x)) l FROM mail)
SELECT message_id, array_to_string(list_filter(CASE WHEN list_position(l, 'Best regards') > 0 THEN l[1:list_position(l, 'Best regards') - 1] ELSE l END, lambda x: x <> '' AND NOT starts_with(x, '>') AND NOT starts_with(lower(x), 'from:')), chr(10)) body FROM l""", False)
def t21(spark, d):
    end = F.when(F.col("message_id") % 3 == 0, "\n> quoted\nFrom: me\nkept\nBest regards\ngone").otherwise("\n ")
    return mail(spark, d).select("message_id", T.clean_body(F.concat("body", end)).alias("body"))


@query("t24_extracted_candidates")
def t24(spark, d):
    extra = F.element_at(F.array(*(F.lit(x) for x in ("\nPlease confirm this by 2026-07-20.", "\nWork is blocked. Issue resolved.", "\nI will send the report tomorrow?", ""))), (F.col("message_id") % 4 + 1).cast("int"))
    at = F.date_add(F.lit("2026-07-01").cast("date"), (F.col("message_id") % 28).cast("int"))
    return M.extract(mail(spark, d).withColumn("body", F.concat("body", extra)).withColumn("at", at))


@query("a24_thread_summary", "SELECT conv_id thread_id, count(*) n_messages, max(turn) last_at, count(DISTINCT role) n_senders FROM conversations GROUP BY conv_id", False)
def a24(spark, d):
    return M.thread_summary(A.table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("at"), F.col("role").alias("sender")))


@query("u4_timeline", """SELECT *, row_number() OVER (PARTITION BY subject ORDER BY "at", kind, id) AS position FROM (SELECT o_custkey subject, 'order' kind, o_orderkey id, CAST(o_orderdate AS DATE) AS "at" FROM orders UNION ALL SELECT o_custkey, 'payment', o_orderkey, CAST(o_orderdate AS DATE) + 14 FROM orders WHERE o_orderkey % 7 <> 0)""", False)
def u4(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("at"))
    return M.timeline(("order", o), ("payment", o.where("id % 7 <> 0").withColumn("at", F.date_add("at", 14))))


# Scalar functions.
@query("n_amount_functions", "SELECT bill_id, CAST(amount AS DOUBLE) parsed, abs(amount - round(amount, 0)) <= 0.01 AND round(amount, 0) <> 0 near_whole, CASE WHEN bill_id % 3 = 0 THEN 'unpaid' WHEN bill_id % 3 = 1 THEN 'paid' ELSE 'partially_paid' END status FROM bills")
def n_functions(spark, d):
    i = A.bills(spark, d)
    written = F.regexp_replace(F.col("amount").cast("string"), r"\.", ",")
    paid = F.when(F.col("bill_id") % 3 == 0, 0.0).when(F.col("bill_id") % 3 == 1, F.col("amount").cast("double")).otherwise(F.col("amount").cast("double") / 2)
    return i.select("bill_id", N.parse_decimal(written).cast("double").alias("parsed"), N.amounts_equal(F.col("amount"), F.round("amount", 0)).alias("near_whole"), N.payment_status(F.col("amount").cast("string"), paid.cast("string")).alias("status"))


@query("d_month_pieces", "SELECT o_orderkey AS id, CAST(m AS DATE) AS month, CAST(greatest(m, s) AS DATE) AS piece_start, CAST(least(last_day(CAST(m AS DATE)), e) AS DATE) piece_end FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) s, CAST(o_orderdate AS DATE) + 75 AS e, unnest(generate_series(date_trunc('month', CAST(o_orderdate AS DATE)), date_trunc('month', CAST(o_orderdate AS DATE) + 75), INTERVAL 1 MONTH)) m FROM orders)", False)
def d_months(spark, d):
    day = F.col("o_orderdate").cast("date")
    x = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.explode(D.months_between_dates(day, F.date_add(day, 75))).alias("m"))
    return x.select("id", "m.month", F.col("m.start").alias("piece_start"), F.col("m.end").alias("piece_end"))


@query("d_parsed_dates", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders", False)
def d_parsed(spark, d):
    k = F.col("o_orderkey") % 3
    day = F.col("o_orderdate")
    written = F.when(k == 0, F.date_format(day, "d.M.yyyy")).when(k == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), D.any_date(written).alias("day"))


@query("t_subject_functions", f"WITH mail AS ({MESSAGES}) SELECT message_id, trim(regexp_replace(regexp_replace(lower(trim(subject)), '^((re|fw|fwd)\\s*:\\s*)+', ''), '\\s+', ' ', 'g')) subject, regexp_replace(lower(subject), '[^0-9a-zõäöü]+', '', 'g') AS key FROM mail", False)
def t_subjects(spark, d):
    return mail(spark, d).select("message_id", T.clean_subject(F.col("subject")).alias("subject"), T.lookup_key(F.col("subject")).alias("key"))


@query("t_page_text", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages", False)
def t_pages(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("p4_search", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), 'auto') OR c_custkey = 12", False)
def p4(spark, d):
    needle = lambda c, x: F.lower(c).contains(x)
    return A.table(spark, d, "customer").where(needle("c_name", "12") | needle("c_mktsegment", "auto") | (F.col("c_custkey") == 12)).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    batch = A.table(spark, d, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("x14_stream_counters", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) n FROM events GROUP BY 1, 2", False)
def x14(spark, d):
    out = state.run_to_table(state.sync_counters(events_stream(spark, d)), stream_dir(spark), "complete")
    last = out.agg(F.max("epoch").alias("_e"))
    return out.join(last, out.epoch == last["_e"]).select(F.to_date("window.start").alias("day"), "event_type", "n")


@query("x11_stream_cursors", "SELECT user_id, count(DISTINCT date_trunc('microsecond', ts)) n_moved, count(*) n_seen FROM events GROUP BY user_id", False)
def x11(spark, d):
    out = state.run_to_table(state.cursors(events_stream(spark, d).select("user_id", "ts")), stream_dir(spark), "update")
    return out.groupBy("user_id").agg(F.max("n_moved").alias("n_moved"), (F.max("n_moved") + F.max("n_refused")).alias("n_seen"))


LIFE = """seen AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('error', 'purchase') THEN 'met' WHEN event_type <> 'signup' THEN 'clear' END verb FROM events WHERE ts IS NOT NULL),
moved AS (SELECT *, lag(verb) OVER w before FROM seen WHERE verb IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
gone AS (SELECT *, max(CASE WHEN verb = 'clear' AND before = 'met' THEN epoch_ms(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) resolved FROM moved)"""


@query(
    "x7_stream_alert_life",
    f"""WITH {LIFE} SELECT CAST(user_id AS VARCHAR) fingerprint, event_id seq, CASE WHEN verb = 'met' AND before = 'met' THEN 'updated' WHEN verb = 'met' AND epoch_ms(ts) < resolved + 43200000 THEN 'reopened'
 WHEN verb = 'met' THEN 'opened' WHEN before = 'met' THEN 'resolved' ELSE 'unchanged' END AS action FROM gone UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 'unchanged' FROM seen WHERE verb IS NULL""",
    False,
)
def x7_stream(spark, d):
    verb = "CASE WHEN event_type IN ('error', 'purchase') THEN 'met' WHEN event_type <> 'signup' THEN 'clear' END AS verb"
    seen = events_stream(spark, d).selectExpr("CAST(user_id AS STRING) AS fingerprint", "ts", "event_id AS seq", verb, "CAST(NULL AS TIMESTAMP) AS until")
    with state.rocks(spark):
        return state.run_to_table(state.alert_states(seen, timedelta(hours=12)), stream_dir(spark)).select("fingerprint", "seq", "action")


def entry(spark: SparkSession, d: str) -> DataFrame:
    return finance.a1(spark, d).orderBy(F.desc("revenue"), "project_id")
