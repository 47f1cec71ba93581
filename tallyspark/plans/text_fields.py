"""Queries on fields in the texts of bills and mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fields as X, text as T
from ..operators import matching
from ..sources import adapters as A
from ..sources.shared import spread
from .registry import query

# A text for each bill, in four layouts, the same expression in Spark and in SQL.
TEXT = """CASE bill_id % 4
 WHEN 0 THEN concat('Arve nr: ', number, '\\nArve kuupäev: 05.03.1996\\nMaksetähtaeg: 19.03.96\\nSumma ', net, '\\nKäibemaks 24% ', vat, '\\nKokku tasuda ', gross, ' EUR\\nIBAN EE', lpad(concat('', bill_id), 18, '1'), '\\n', issuer, ' Registrikood: 1', lpad(concat('', bill_id), 7, '0'), '\\nKMKR: EE1', lpad(concat('', bill_id), 8, '0'))
 WHEN 1 THEN concat('INVOICE\\n12.04.1996\\nInvoice no. ', number, '\\nPayable\\n\\n', net, '\\nKM 24% 1 234,56\\nHind käibemaksuta 9,99\\n', issuer, '\\nTallinn\\nReg. nr. 7', lpad(concat('', bill_id), 7, '0'))
 WHEN 2 THEN concat('Arve ', number, ' 1996-05-06\\nDue date: 1996/06/07\\nTotal ', gross, '\\nSumma kokku ', net, '\\nVAT ', vat, '\\nSeller Buyer\\n', issuer, ' tel 123\\nother line')
 ELSE concat('Meeldetuletus ', bill_id, '\\nAKT 05-32 Näide OÜ - (25', lpad(concat('', bill_id % 1000), 3, '0'), ' - Torn / Mari) 6 20,00 120,00\\nAKT 05-33 (26000 - Maja / 26070\\nMari)\\n8 20,00 160,00') END"""


def texts(spark, d) -> DataFrame:
    comma = lambda c: F.regexp_replace(c.cast("decimal(20,2)").cast("string"), r"\.", ",")
    b = spread(A.bills(spark, d)).withColumn("n", F.col("amount") * 4).select("bill_id", "number", "issuer", "subject", "attachment_names", comma(F.col("n")).alias("net"), comma(F.col("n") / 4).alias("vat"), comma(F.col("n") + F.col("n") / 4).alias("gross"))
    return b.select("bill_id", "number", "issuer", "subject", "attachment_names", F.expr(TEXT).alias("text"))


COMMA = "replace(CAST(CAST({0} AS DECIMAL(20,2)) AS VARCHAR), '.', ',')"
TEXTS = f"""texts AS (SELECT bill_id, number, issuer, subject, attachment_names, {TEXT.replace(chr(92) + "n", "' || chr(10) || '")} AS text FROM
 (SELECT *, {COMMA.format("amount * 4")} net, {COMMA.format("amount")} vat, {COMMA.format("amount * 5")} gross FROM bills)),
flat AS (SELECT *, regexp_replace(text, '[ \\t]+', ' ', 'g') t, string_split(regexp_replace(text, '[ \\t]+', ' ', 'g'), chr(10)) l FROM texts)"""
AMOUNT, DATE = X.AMOUNT, X.DATE
NORMAL = r"(CASE WHEN contains({0}, ',') AND contains({0}, '.') THEN replace(replace(regexp_replace({0}, '[ \x{{A0}}]', '', 'g'), '.', ''), ',', '.') ELSE replace(regexp_replace({0}, '[ \x{{A0}}]', '', 'g'), ',', '.') END)"
escaped = lambda labels: "|".join(x.replace("(", r"\(").replace(")", r"\)") for x in labels)


def amount_sql(labels: list[str], vat: bool = False) -> str:
    some = " OR ".join(f"contains(lower(x), '{w}')" for w in labels)
    without = f" AND NOT regexp_matches(lower(x), '{X.WITHOUT_VAT}')" if vat else ""
    line = f"list_filter(l, lambda x: ({some}) AND regexp_matches(x, '{AMOUNT}'){without})[1]"
    raw = f"CASE WHEN {line} IS NOT NULL THEN regexp_extract_all({line}, '{AMOUNT}', 1)[-1] ELSE coalesce(regexp_extract_all(t, '(?i)(?:{escaped(labels)})[^\\d]{{0,60}}{AMOUNT}', 1)[-1], '') END"
    return f"(SELECT {NORMAL.format('v')} FROM (SELECT {raw} v))"


DAY = """(SELECT CASE WHEN len(p) <> 3 THEN v ELSE concat_ws('-', lpad(CASE WHEN length(p[1]) = 4 THEN p[1] WHEN length(p[3]) = 2 THEN '20' || p[3] ELSE p[3] END, 4, '0'), lpad(p[2], 2, '0'), lpad(CASE WHEN length(p[1]) = 4 THEN p[3] ELSE p[1] END, 2, '0')) END
 FROM (SELECT v, string_split(translate(v, './', '--'), '-') p FROM (SELECT {0} v)))"""


def date_sql(labels: list[str]) -> str:
    return DAY.format(f"regexp_extract(t, '(?i)(?:{escaped(labels)})[^\\d]{{0,40}}{DATE}', 1)")


@query("t11_labelled_amounts", f", {TEXTS} SELECT bill_id, {amount_sql(X.TOTAL_LABELS)} total, {amount_sql(X.VAT_LABELS, True)} vat FROM flat")
def t11(spark, d):
    t = texts(spark, d).withColumn("t", X.compact(F.col("text")))
    return t.select("bill_id", X.labelled_amount(F.col("t"), X.TOTAL_LABELS).alias("total"), X.labelled_amount(F.col("t"), X.VAT_LABELS, vat=True).alias("vat"))


@query(
    "n7_gross_amounts",
    f""", {TEXTS}, x AS (SELECT bill_id, t, {amount_sql(X.TOTAL_LABELS)} total, {amount_sql(X.VAT_LABELS, True)} vat FROM flat)
SELECT bill_id, CASE WHEN TRY_CAST(vat AS DOUBLE) > 0 AND len(list_filter(list_transform(regexp_extract_all(t, '{AMOUNT}', 1), lambda y: TRY_CAST({NORMAL.format("y")} AS DOUBLE)), lambda y: abs(y - round_even(TRY_CAST(total AS DOUBLE) + TRY_CAST(vat AS DOUBLE), 2)) < 0.005)) > 0
 THEN printf('%.2f', round_even(TRY_CAST(total AS DOUBLE) + TRY_CAST(vat AS DOUBLE), 2)) ELSE total END gross FROM x""",
)
def n7(spark, d):
    t = texts(spark, d).withColumn("t", X.compact(F.col("text")))
    total, vat = X.labelled_amount(F.col("t"), X.TOTAL_LABELS), X.labelled_amount(F.col("t"), X.VAT_LABELS, vat=True)
    return t.select("bill_id", X.gross_amount(F.col("t"), total, vat).alias("gross"))


@query("t12_labelled_dates", f", {TEXTS} SELECT bill_id, {date_sql(X.DATE_LABELS)} bill_date, {date_sql(X.DUE_LABELS)} due_date FROM flat")
def t12(spark, d):
    t = texts(spark, d).withColumn("t", X.compact(F.col("text")))
    return t.select("bill_id", X.labelled_date(F.col("t"), X.DATE_LABELS).alias("bill_date"), X.labelled_date(F.col("t"), X.DUE_LABELS).alias("due_date"))


NUMBER = "trim(coalesce(nullif(regexp_extract(t, '{s}', 1) || regexp_extract(t, '{s}', 2), ''), {p}, ''), ' .:-')".format(s=X.SERIES, p=", ".join(f"nullif(regexp_extract(t, '(?i){p}', 1), '')" for p in X.NUMBER_PATTERNS))


@query("t13_bill_numbers", f", {TEXTS} SELECT bill_id, {NUMBER} AS number FROM flat")
def t13(spark, d):
    return texts(spark, d).select("bill_id", X.bill_number(X.compact(F.col("text"))).alias("number"))


@query("t14_t16_extracted_fields")
def t16(spark, d):
    """All fields, those of the text first and then those that the register knows."""
    t = texts(spark, d).withColumn("f", X.extract(F.col("text"), "owncompany"))
    names = ["issuer_name", "invoice_number", "amount_total", "vat_amount", "payment_details", "due_date", "invoice_date", "issuer_reg_code", "issuer_vat_no"]
    known = F.struct(*(F.when(F.lit(n == "invoice_number"), F.col("number")).when(F.lit(n == "issuer_name"), F.col("issuer")).otherwise("").alias(n) for n in names))
    merged = X.merge(F.col("f"), known, names)
    return t.select("bill_id", merged.alias("m")).select("bill_id", "m.*")


@query("t17_project_lines")
def t17(spark, d):
    return texts(spark, d).select("bill_id", F.posexplode(X.project_lines(F.col("text"))).alias("line", "x")).select("bill_id", "line", "x.*")


@query(
    "t18_first_companies",
    r"""SELECT bill_id, trim(CASE WHEN regexp_extract(c, '(?i)\b(.+?\b(?:OÜ|OU|AS|MTÜ|SA|FIE))(?:[^\p{L}\d_]|$)', 1) <> '' THEN regexp_extract(c, '(?i)\b(.+?\b(?:OÜ|OU|AS|MTÜ|SA|FIE))(?:[^\p{L}\d_]|$)', 1) ELSE trim(string_split(c, ' tel')[1]) END, ' ,.;:-') company
 FROM (SELECT bill_id, CASE WHEN bill_id % 2 = 0 THEN issuer || ' tel 55 12' ELSE replace(issuer, ' OÜ', '') || '  GmbH tel 123' END c0, regexp_replace(CASE WHEN bill_id % 2 = 0 THEN issuer || ' tel 55 12' ELSE replace(issuer, ' OÜ', '') || '  GmbH tel 123' END, '\s+', ' ', 'g') c FROM bills)""",
)
def t18(spark, d):
    c = F.expr("CASE WHEN bill_id % 2 = 0 THEN concat(issuer, ' tel 55 12') ELSE concat(replace(issuer, ' OÜ', ''), '  GmbH tel 123') END")
    return A.bills(spark, d).select("bill_id", X.first_company(c).alias("company"))


# Mail: a message for each bill, with attachments of several kinds.
MAIL = """bill_id, CASE WHEN bill_id % 3 = 0 THEN concat('RE: Arve ', number) WHEN bill_id % 5 = 0 THEN 'FW:  Meeldetuletus tasumata' WHEN bill_id % 7 = 0 THEN 'Juuni uudiskiri' ELSE concat('Order for ', issuer) END AS subject, issuer AS sender,
 CASE WHEN bill_id % 4 = 0 THEN concat('Tere, summas 122,00 EUR. ', number) WHEN bill_id % 4 = 1 THEN 'receipt of your payment 5,10 €' ELSE 'hello' END AS body,
 CASE bill_id % 6 WHEN 0 THEN concat('RE: doc', bill_id % 100, '.PDF; b.png') WHEN 1 THEN 'arve.jpg;photo.png' WHEN 2 THEN concat('x.xml;invoice-', bill_id, '.pdf') ELSE '' END AS attachments, CAST(bill_id % 90 AS INT) AS given"""


def mail(spark, d) -> DataFrame:
    m = A.bills(spark, d).selectExpr(*_split(MAIL))
    return m.withColumn("s", X.mail_score([F.col("subject"), F.col("sender"), F.col("body")], F.col("attachments"))).select("*", "s.*")


def _split(exprs: str) -> list[str]:
    out, depth, cur, quote = [], 0, "", False
    for ch in exprs:
        quote ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quote else 0
        if ch == "," and not depth and not quote:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


STRONG = "list_filter(list_filter(list_transform(string_split({0}, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_matches(lower(x), '\\.(?:" + "|".join(T.STRONG_SUFFIXES) + ")$'))"
IMAGES = "list_filter(list_transform(string_split(attachments, ';'), lambda x: lower(trim(x))), lambda x: regexp_matches(x, '\\.(?:jpg|jpeg|png)$') AND (" + " OR ".join(f"contains(x, '{w}')" for w in X.IMAGE_WORDS) + "))"
CUT = "list_transform({0}, lambda x: CASE WHEN x LIKE '%.pdf' OR x LIKE '%.xml' OR x LIKE '%.xls' OR x LIKE '%.csv' THEN left(x, length(x) - 4) WHEN x LIKE '%.xlsx' THEN left(x, length(x) - 5) ELSE x END)"
STOPS = ", ".join(f"'{w}'" for w in X.NO_NUMBER)


def numbers_sql(text: str) -> str:
    found = "list_concat(" * 2 + ", ".join(f"regexp_extract_all(lower({text}), '{p}', 1)" + (")" if i else "") for i, p in enumerate([*X.LABELLED, X.GENERIC]))
    bare = CUT.replace("{0}", f"list_transform({found}, lambda x: trim(x, ' ._-'))")
    return f"list_sort(list_distinct(list_filter({bare}, lambda x: regexp_matches(x, '[0-9]') AND x NOT IN ({STOPS}))))"


PLAIN = r"regexp_replace(regexp_replace(trim(lower({0})), '^(re|fw|fwd)\s*:\s*', ''), '\s+', ' ', 'g')"
hits = lambda words: " + ".join(f"contains(t, '{w}')::INT" for w in words)
MAILS = f"""mails AS (SELECT {MAIL} FROM bills), seen AS (SELECT *, lower(concat_ws(' ', subject, sender, body, replace(attachments, ';', ' '))) t FROM mails),
counted AS (SELECT *, {hits(X.INVOICE_WORDS)} i, {hits(X.RECEIPT_WORDS)} r, {hits(X.NEGATIVE_WORDS)} n, len({STRONG.format("attachments")}) > 0 strong, len({IMAGES}) > 0 image, regexp_matches(t, '{X.MAIL_NUMBER}') num, regexp_matches(t, '\\b\\d+[,.]\\d{{2}}\\s*(eur|€)(?:[^\\p{{L}}\\d_]|$)') eur FROM seen),
scored AS (SELECT *, greatest(0, least(100, CASE WHEN i > 0 THEN least(45, 18 + i * 7) ELSE 0 END + CASE WHEN r > 0 THEN least(25, 10 + r * 5) ELSE 0 END + CASE WHEN strong THEN 25 ELSE 0 END + CASE WHEN image THEN 15 ELSE 0 END + CASE WHEN num THEN 15 ELSE 0 END + CASE WHEN eur THEN 10 ELSE 0 END - CASE WHEN n > 0 THEN 25 ELSE 0 END)) score,
 concat_ws('; ', CASE WHEN i > 0 THEN 'invoice keywords' END, CASE WHEN r > 0 THEN 'receipt/payment keywords' END, CASE WHEN strong THEN 'invoice-like attachments' END, CASE WHEN image THEN 'named image attachments' END, CASE WHEN num THEN 'possible invoice number' END, CASE WHEN eur THEN 'possible euro amount' END, CASE WHEN n > 0 THEN 'negative keywords' END) reasons FROM counted)"""


@query("t9_mail_scores", f", {MAILS} SELECT bill_id, score, reasons FROM scored")
def t9(spark, d):
    return mail(spark, d).select("bill_id", "score", "reasons")


@query("t4_mail_numbers", f", {MAILS} SELECT bill_id, array_to_string({numbers_sql("subject || ' ' || attachments")}, ',') numbers FROM mails")
def t4(spark, d):
    return mail(spark, d).select("bill_id", F.array_join(X.mail_numbers(F.concat_ws(" ", "subject", "attachments")), ",").alias("numbers"))


KEY = f"""CASE WHEN len({STRONG.format("attachments")}) > 0 THEN 'att:' || array_to_string(list_sort(list_transform({STRONG.format("attachments")}, lambda y: {PLAIN.format("y")})), '|')
 WHEN len({numbers_sql("sender || ' ' || subject")}) > 0 THEN 'num:' || {PLAIN.format("sender")} || '|' || array_to_string({numbers_sql("sender || ' ' || subject")}, '|') ELSE 'sub:' || {PLAIN.format("sender")} || '|' || {PLAIN.format("subject")} END"""
CLASS = f"""CASE WHEN {" OR ".join(f"contains({PLAIN.format(chr(39).join(['concat_ws(', ' ', ', subject, reasons, attachments)']))}, '{w}')" for w in X.REMINDERS)} THEN 'reminder_or_debt_notice' WHEN strong AND len({numbers_sql("subject || ' ' || attachments")}) > 0 THEN 'likely_invoice' WHEN strong THEN 'possible_invoice'
 WHEN contains(reasons, 'invoice keywords') AND contains(reasons, 'possible invoice number') THEN 'possible_invoice' ELSE 'needs_review' END"""
CLEANED = f"""{MAILS}, mail_classes AS (SELECT *, {KEY} AS key, {CLASS} AS class FROM scored), cleaned AS (SELECT bill_id, key, class, greatest(0, least(100, score + CASE WHEN class = 'reminder_or_debt_notice' THEN -20 WHEN class = 'likely_invoice' THEN 15 WHEN class = 'possible_invoice' AND strong THEN 5 WHEN class = 'possible_invoice' THEN 0 ELSE -10 END)) clean_score FROM mail_classes)"""


def cleaned(spark, d) -> DataFrame:
    m = mail(spark, d).withColumn("c", X.mail_class(F.col("subject"), F.col("reasons"), F.col("attachments"), F.col("score")))
    return m.select("bill_id", X.mail_key(F.col("sender"), F.col("subject"), F.col("attachments")).alias("key"), F.col("c.class").alias("class"), F.col("c.score").alias("clean_score"))


@query("t7_t8_clean_mail", f", {CLEANED} SELECT * FROM cleaned")
def t78(spark, d):
    return cleaned(spark, d)


@query("o3_clean_order", f", {CLEANED}, kept AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY clean_score DESC, bill_id DESC) > 1 AS is_duplicate FROM cleaned) SELECT bill_id, is_duplicate, class, clean_score, row_number() OVER (ORDER BY is_duplicate, class <> 'likely_invoice', clean_score DESC, bill_id) AS position FROM kept ORDER BY position LIMIT 200")
def o3(spark, d):
    """Duplicates last, likely bills first, then by score and time: the first 200 are the list's page."""
    from pyspark.sql import Window as W

    kept = matching.keep_best(cleaned(spark, d), "key", F.desc("clean_score"), F.desc("bill_id"))
    order = [F.asc("is_duplicate"), F.asc(F.col("class") != "likely_invoice"), F.desc("clean_score"), F.asc("bill_id")]
    page = kept.orderBy(*order).limit(200)
    return page.select("bill_id", "is_duplicate", "class", "clean_score", F.row_number().over(W.orderBy(*order)).alias("position"))


@query("t5_reference_tokens", ", " + f"{MAILS} SELECT bill_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_transform(regexp_extract_all(lower(subject || ' ' || attachments), '\\b[a-z]{{0,8}}\\d[a-z0-9./-]{{2,}}\\b'), lambda x: trim(x, ' ._-')), lambda x: CASE WHEN x LIKE '%.pdf' OR x LIKE '%.xml' THEN left(x, length(x) - 4) ELSE x END), lambda x: regexp_matches(x, '[0-9]')))), ',') tokens FROM mails")
def t5(spark, d):
    return mail(spark, d).select("bill_id", F.array_join(T.reference_tokens(F.concat_ws(" ", "subject", "attachments")), ",").alias("tokens"))


@query("t6_strong_attachments", f", {MAILS} SELECT bill_id, array_to_string({STRONG.format('attachments')}, '|') names FROM mails")
def t6(spark, d):
    return mail(spark, d).select("bill_id", F.array_join(T.strong_attachments(F.col("attachments")), "|").alias("names"))


@query("t10_valid_accounts", "SELECT bill_id, coalesce(CASE left(iban, 2) WHEN 'EE' THEN length(iban) = 20 END, length(iban) BETWEEN 15 AND 34) valid FROM (SELECT bill_id, CASE WHEN bill_id % 5 = 0 THEN iban || '1' WHEN bill_id % 5 = 1 THEN 'FR' || iban ELSE iban END iban FROM bills)")
def t10(spark, d):
    c = F.expr("CASE WHEN bill_id % 5 = 0 THEN concat(iban, '1') WHEN bill_id % 5 = 1 THEN concat('FR', iban) ELSE iban END")
    return A.bills(spark, d).select("bill_id", T.valid_iban(c).alias("valid"))
