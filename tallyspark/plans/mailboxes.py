"""Mail and output queries: documents as MIME messages, parsed again, a sync loop over them as a stream, split outputs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..sources import adapters as A, mail, outputs
from ..sources.shared import shared_dir
from .registry import query

SUBJECT = "concat('Re: FW: ', coalesce(source, ''), ' ', doc_id % 50)"
HEAD = f"""concat('From: Saatja <p', doc_id % 40, '@x.ee>\\r\\nTo: a@y.ee, b@y.ee\\r\\nMessage-ID: <', doc_id, '@x.ee>\\r\\nSubject: =?utf-8?B?', replace(base64(encode({SUBJECT}, 'UTF-8')), '\\r\\n', ''), '?=\\r\\n',
 CASE doc_id % 3 WHEN 0 THEN concat('References: <t', doc_id div 5, '@x.ee>\\r\\n') WHEN 1 THEN concat('In-Reply-To: <', doc_id - 1, '@x.ee>\\r\\n') ELSE '' END,
 'MIME-Version: 1.0\\r\\nContent-Type: multipart/mixed; boundary="=-part"\\r\\n\\r\\n')"""
BODY = """concat('--=-part\\r\\nContent-Type: text/plain; charset="utf-8"\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n', base64(encode(coalesce(text, ''), 'UTF-8')), '\\r\\n')"""
FILE = """CASE WHEN doc_id % 7 = 0 THEN concat('--=-part\\r\\nContent-Type: application/pdf\\r\\nContent-Transfer-Encoding: base64\\r\\nContent-Disposition: attachment; filename="arve_', doc_id, '.pdf"\\r\\n\\r\\n', base64(encode(coalesce(source, ''), 'UTF-8')), '\\r\\n') ELSE '' END"""
RAW = ["coalesce(lang, 'none') AS mailbox", "CAST(1 AS BIGINT) AS epoch", "CAST(doc_id AS BIGINT) AS uid", f"encode(concat({HEAD}, {BODY}, {FILE}, '--=-part--\\r\\n'), 'UTF-8') AS content"]


@query(
    "s4_parsed_mail",
    """SELECT coalesce(lang, 'none') mailbox, doc_id AS uid, '<' || doc_id || '@x.ee>' AS internet_message_id, 'p' || (doc_id % 40) || '@x.ee' AS sender_email,
 'Re: FW: ' || coalesce(source, '') || ' ' || (doc_id % 50) AS subject,
 CASE doc_id % 3 WHEN 0 THEN '<t' || (doc_id // 5) || '@x.ee>' WHEN 1 THEN '<' || (doc_id - 1) || '@x.ee>' ELSE trim(lower(coalesce(source, '') || ' ' || (doc_id % 50))) END AS thread_key,
 'a@y.ee,b@y.ee' AS recipients, md5(coalesce(text, '')) AS body_md5, length(coalesce(text, '')) AS n_chars, CASE WHEN doc_id % 7 = 0 THEN 'arve_' || doc_id || '.pdf' ELSE '' END AS files,
 CASE WHEN doc_id % 7 = 0 THEN strlen(coalesce(source, '')) ELSE 0 END AS file_bytes FROM documents""",
    False,
)
def s4(spark, d) -> DataFrame:
    rows = mail.parts(A.table(spark, d, "documents").selectExpr(*RAW))
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    return rows.select(
        "mailbox",
        "uid",
        "internet_message_id",
        "sender_email",
        "subject",
        "thread_key",
        names("recipients", "email").alias("recipients"),
        F.md5(F.col("body_text").cast("binary")).alias("body_md5"),
        F.char_length("body_text").alias("n_chars"),
        names("attachments", "name").alias("files"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["size"]).alias("file_bytes"),
    )


@query("x12_mail_sync", "SELECT coalesce(lang, 'none') mailbox, 1 AS epoch, max(doc_id) AS last_uid, count(*) AS n_imported FROM documents GROUP BY 1", False)
def x12(spark, d) -> DataFrame:
    stream = spark.readStream.schema(A.table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    return mail.progress(mail.sync(stream.selectExpr(*RAW), f"{shared_dir(spark)}/mail-{uuid.uuid4().hex}"))


KINDS = {"all": "true", "pending": "status = 'pending'", "confirmed": "status = 'confirmed'", "rejected": "status = 'rejected'", "sales": "kind = 'sale'", "large_purchases": "kind = 'purchase' AND amount > 200000"}


@query(
    "s14_split_outputs",
    ", " + "kinds AS (" + " UNION ALL ".join(f"SELECT '{k}' AS output, * FROM bills WHERE {c}" for k, c in KINDS.items()) + ") SELECT output, count(*) n, CAST(sum(amount) AS DOUBLE) total, min(number) AS first_number FROM kinds GROUP BY output",
)
def s14(spark, d) -> DataFrame:
    path = f"{shared_dir(spark)}/outputs-{uuid.uuid4().hex}"
    outputs.publish(A.bills(spark, d), path, {k: F.expr(c) for k, c in KINDS.items()})
    schema = ", ".join(f"{c} {t}" for c, t in A.bills(spark, d).dtypes)
    found = [outputs.read(spark, path, k, schema).withColumn("output", F.lit(k)) for k in KINDS]
    return reduce(DataFrame.unionByName, found).groupBy("output").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"), F.min("number").alias("first_number"))
