"""Queries that match bank rows, bills, ledger rows and mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import payment_status
from ..functions.text import lookup_key, remittance_number
from ..operators import matching as M
from ..sources import adapters as A
from .registry import doubles, query

PAID = "CASE bill_id % 4 WHEN 1 THEN '0' WHEN 2 THEN CAST(CAST(amount / 2 AS DECIMAL(20,2)) AS VARCHAR) ELSE CAST(amount AS VARCHAR) END"


def bank_side(spark, d, kind=None, debits: bool = False) -> DataFrame:
    b = A.bank(spark, d)
    return M.side(b.where("direction = 'DBIT'") if debits else b, "txn_id", "amount", "party", ["remittance", "party"], account="iban", kind=kind, order=["booking_date"])


def bill_side(spark, d) -> DataFrame:
    b = A.bills(spark, d).where("status <> 'rejected'")
    return M.side(b, "bill_id", "amount", "issuer", ["number", "subject", "attachment_names"], "number", "iban", F.col("kind"), ["bill_date", "issuer"])


def ledger(spark, d) -> DataFrame:
    """Purchase bills as the ledger has them: another spelling, some paid, some in part."""
    b = A.bills(spark, d).where("kind = 'purchase' and bill_id % 9 <> 0")
    paid = F.expr(PAID.replace("VARCHAR", "STRING"))
    return b.select("bill_id", "number", "amount", F.col("issuer").alias("supplier"), "bill_date", F.col("subject").alias("description"), paid.alias("paid"), payment_status(F.col("amount").cast("string"), paid).alias("payment_status"))


def ledger_side(spark, d) -> DataFrame:
    return M.side(ledger(spark, d), "bill_id", "amount", "supplier", ["number", "description"], "number", order=["bill_date"])


def mail(spark, d) -> DataFrame:
    return A.bills(spark, d).where("kind = 'purchase' and bill_id % 5 <> 0")


def mail_side(spark, d) -> DataFrame:
    return M.side(mail(spark, d), "bill_id", "amount", "issuer", ["number", "subject", "attachment_names"], "number", order=["bill_date"])


def to_bank(spark, d, threshold: int = 50, rows: DataFrame | None = None) -> DataFrame:
    return M.best_matches(ledger_side(spark, d) if rows is None else rows, bank_side(spark, d, debits=True), M.LEDGER_BANK, threshold)


def to_mail(spark, d, rows: DataFrame | None = None) -> DataFrame:
    return M.best_matches(ledger_side(spark, d) if rows is None else rows, mail_side(spark, d), M.LEDGER_MAIL)


TOK = r"""list_sort(list_distinct(list_filter(list_transform(list_transform(regexp_extract_all(lower({0}), '\b[a-z]{{0,8}}\d[a-z0-9./-]{{2,}}\b'), lambda x: trim(x, ' ._-')),
 lambda x: CASE WHEN x LIKE '%.pdf' OR x LIKE '%.xml' THEN left(x, length(x) - 4) ELSE x END), lambda x: regexp_matches(x, '[0-9]'))))"""
WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[0-9a-z]+'), lambda w: length(w) > 1 AND w NOT IN ('aktsiaselts','as','fie','mtu','osauehing','osauhing','ou','oy','sa')))"
COMPANY = f"len(list_intersect({WORDS.format('l.party')}, {WORDS.format('r.party')})) >= least(2, len({WORDS.format('l.party')}), len({WORDS.format('r.party')})) AND least(len({WORDS.format('l.party')}), len({WORDS.format('r.party')})) > 0"
SIDES = f"""
bank_all AS (SELECT txn_id id, CASE direction WHEN 'CRDT' THEN 'sale' ELSE 'purchase' END kind, amount, lower(trim(party)) party, NULL::VARCHAR AS number, nullif(regexp_replace(coalesce(iban, ''), '[^0-9]+', '', 'g'), '') account, {TOK.format("remittance || ' ' || party")} tokens, booking_date t1, '' t2, direction FROM bank),
bill_all AS (SELECT bill_id id, kind, amount, lower(trim(issuer)) party, lower(trim(number)) AS number, nullif(regexp_replace(coalesce(iban, ''), '[^0-9]+', '', 'g'), '') account, {TOK.format("number || ' ' || subject || ' ' || attachment_names")} tokens, bill_date t1, issuer t2 FROM bills WHERE status <> 'rejected'),
ledger AS (SELECT bill_id, number, amount, issuer supplier, bill_date, subject description, {PAID} paid FROM bills WHERE kind = 'purchase' AND bill_id % 9 <> 0),
ledger_all AS (SELECT bill_id id, '' kind, amount, lower(trim(supplier)) party, lower(trim(number)) AS number, NULL::VARCHAR account, {TOK.format("number || ' ' || description")} tokens, bill_date t1, '' t2,
 CASE WHEN paid::DOUBLE <= 0 THEN 'unpaid' WHEN paid::DOUBLE + 0.005 >= amount::DOUBLE THEN 'paid' ELSE 'partially_paid' END payment_status FROM ledger),
mail_all AS (SELECT bill_id id, '' kind, amount, lower(trim(issuer)) party, lower(trim(number)) AS number, NULL::VARCHAR account, {TOK.format("number || ' ' || subject || ' ' || attachment_names")} tokens, bill_date t1, '' t2 FROM bills WHERE kind = 'purchase' AND bill_id % 5 <> 0),
debits AS (SELECT * REPLACE ('' AS kind) FROM bank_all WHERE direction = 'DBIT')"""


def match_sql(left: str, right: str, w: M.Weights, name: str, threshold: int = 50) -> str:
    """best_matches() for DuckDB: all pairs that share an amount, a token, an account or a company word, scored."""
    number = "list_contains(r.tokens, l.number)" if w.number_of == "left" else "list_contains(l.tokens, r.number)"
    keyed = lambda t: f"(SELECT id, kind, unnest(list_distinct(list_concat(list_concat(tokens, [coalesce(number, '')]), [coalesce(account, '')]))) k FROM {t})"
    company = f" OR ({COMPANY})" if w.company else ""
    return f"""
{name}_pairs AS (SELECT l.id l, r.id r FROM {left} l JOIN {right} r ON l.kind = r.kind AND l.amount = r.amount UNION SELECT l.id, r.id FROM {left} l JOIN {right} r ON l.kind = r.kind AND l.amount = r.amount + 0.01
 UNION SELECT l.id, r.id FROM {left} l JOIN {right} r ON l.kind = r.kind AND l.amount = r.amount - 0.01 UNION SELECT a.id, b.id FROM {keyed(left)} a JOIN {keyed(right)} b ON a.kind = b.kind AND a.k = b.k AND a.k <> ''),
{name}_seen AS (SELECT l.id l, r.id r, r.t1, r.t2, coalesce(abs(l.amount - r.amount) <= 0.01 AND r.amount <> 0 AND l.amount <> 0, false) a, coalesce(l.account = r.account, false) i, coalesce({number}, false) n,
 list_has_any(l.tokens, r.tokens) t, coalesce(contains(l.party, r.party) OR contains(r.party, l.party){company}, false) p FROM {name}_pairs x JOIN {left} l ON l.id = x.l JOIN {right} r ON r.id = x.r),
{name}_scored AS (SELECT *, CASE WHEN a THEN {w.amount} ELSE 0 END + CASE WHEN i THEN {w.account} ELSE 0 END + CASE WHEN n THEN {w.number} WHEN t THEN {w.token} ELSE 0 END + CASE WHEN p THEN {w.party} ELSE 0 END score,
 concat_ws('; ', CASE WHEN a THEN 'amount' END, CASE WHEN i{'' if w.account else ' AND false'} THEN 'iban' END, CASE WHEN n THEN 'invoice_number' END, CASE WHEN t AND NOT n THEN 'token' END, CASE WHEN p THEN 'party' END) reasons FROM {name}_seen),
{name} AS (SELECT l, r, score, reasons FROM {name}_scored WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY l ORDER BY score DESC, t1, t2, r) = 1)"""


J8 = f", {SIDES}, {match_sql('bank_all', 'bill_all', M.BANK_BILL, 'matched')}"
J9 = match_sql("ledger_all", "debits", M.LEDGER_BANK, "by_bank")
J10 = match_sql("ledger_all", "mail_all", M.LEDGER_MAIL, "by_mail")


@query("j8_bank_bill_match", f"{J8} SELECT * FROM matched")
def j8(spark, d):
    return M.best_matches(bank_side(spark, d, F.when(F.col("direction") == "CRDT", "sale").otherwise("purchase")), bill_side(spark, d), M.BANK_BILL)


@query("j9_ledger_bank_match", f", {SIDES}, {J9} SELECT * FROM by_bank")
def j9(spark, d):
    return to_bank(spark, d)


@query("j10_ledger_mail_match", f", {SIDES}, {J10} SELECT * FROM by_mail")
def j10(spark, d):
    return to_mail(spark, d)


COMPARED = f""", {SIDES}, {J9}, {J10}, compared AS (SELECT l.id, payment_status, b.r bank_id, b.score bank_score, m.r mail_id, m.score mail_score, m.r IS NULL missing_in_mail,
 payment_status IN ('paid', 'partially_paid') AND b.r IS NULL paid_without_bank, payment_status = 'unpaid' AND b.r IS NOT NULL unpaid_but_bank FROM ledger_all l LEFT JOIN by_bank b ON b.l = l.id LEFT JOIN by_mail m ON m.l = l.id)"""


def compared(spark, d):
    rows = M.keyed(ledger_side(spark, d), M.LEDGER_BANK, True)  # the same keys for LEDGER_MAIL: texts are read once
    bank, mails = to_bank(spark, d, rows=rows), to_mail(spark, d, rows=rows)
    return M.comparison(ledger(spark, d).select(F.col("bill_id").alias("id"), "payment_status"), bank, mails), bank, mails


@query("j11_three_way", f"{COMPARED} SELECT * FROM compared")
def j11(spark, d):
    return compared(spark, d)[0]


@query("j11_mail_missing_in_ledger", f"{COMPARED} SELECT id FROM mail_all WHERE id NOT IN (SELECT r FROM by_mail)")
def j11_mail(spark, d):
    return M.unmatched(mail(spark, d).select(F.col("bill_id").alias("id")), "id", to_mail(spark, d))


@query("j11_debits_missing_in_ledger", f"{COMPARED} SELECT id FROM debits WHERE id NOT IN (SELECT r FROM by_bank)")
def j11_bank(spark, d):
    return M.unmatched(A.bank(spark, d).where("direction = 'DBIT'").select(F.col("txn_id").alias("id")), "id", to_bank(spark, d))


@query("a35_comparison_summary", f"{COMPARED} SELECT count(*) n_ledger, count(*) FILTER (WHERE missing_in_mail) n_missing_in_mail, count(*) FILTER (WHERE paid_without_bank) n_paid_without_bank, count(*) FILTER (WHERE unpaid_but_bank) n_unpaid_but_bank FROM compared")
def a35(spark, d):
    c = compared(spark, d)[0]
    return c.agg(F.count("*").alias("n_ledger"), *(F.count_if(x).alias(f"n_{x}") for x in ("missing_in_mail", "paid_without_bank", "unpaid_but_bank")))


@query(
    "j12_strict_check",
    f""", {SIDES}, {match_sql("ledger_all", "debits", M.LEDGER_BANK, "strict", 80)} SELECT l.id, s.r bank_id, CASE WHEN s.r IS NOT NULL AND payment_status IN ('paid', 'partially_paid') THEN 'ok_paid' WHEN s.r IS NOT NULL AND payment_status = 'unpaid' THEN 'bank_paid_ledger_unpaid'
 WHEN s.r IS NULL AND payment_status IN ('paid', 'partially_paid') THEN 'ledger_paid_no_bank_match' ELSE 'unpaid_no_bank_match' END status FROM ledger_all l LEFT JOIN strict s ON s.l = l.id
 UNION ALL SELECT NULL, id, 'bank_debit_no_ledger' FROM debits WHERE id NOT IN (SELECT r FROM strict)""",
)
def j12(spark, d):
    bank = A.bank(spark, d).where("direction = 'DBIT'").select(F.col("txn_id").alias("id"))
    return M.strict_check(ledger(spark, d).select(F.col("bill_id").alias("id"), "payment_status"), bank, to_bank(spark, d, 80))


NORM = "regexp_replace(lower({0}), '[^0-9a-zõäöü]+', '', 'g')"


@query(
    "j13_reconciled",
    f"""SELECT coalesce(l.number, b.number) AS number, CAST(coalesce(l.amount, b.amount) AS DOUBLE) amount, CASE WHEN l.number IS NULL THEN 'bank' WHEN b.number IS NULL THEN 'ledger' ELSE 'both' END side
 FROM (SELECT {NORM.format("number")} AS number, amount FROM bills) l FULL JOIN (SELECT {NORM.format("'INV-' || txn_id")} AS number, amount FROM bank) b ON l.number = b.number AND l.amount = b.amount""",
)
def j13(spark, d):
    b = A.bank(spark, d).select(lookup_key(F.concat(F.lit("INV-"), F.col("txn_id").cast("string"))).alias("number"), "amount")
    return doubles(M.reconcile(A.bills(spark, d).select(lookup_key(F.col("number")).alias("number"), "amount"), b))


def positions(spark, d) -> DataFrame:
    return ledger(spark, d).select(F.col("bill_id").alias("row_id"), lookup_key(F.col("number")).alias("number"), "amount", "supplier", F.col("bill_id").alias("position"), (F.col("payment_status") == "paid").alias("paid"))


@query(
    "j14_first_compatible",
    f""", b AS (SELECT txn_id id, amount, {WORDS.format("party")} p, {WORDS.format("party || ' ' || remittance")} t FROM bank WHERE direction = 'DBIT'),
r AS (SELECT bill_id row_id, amount, {WORDS.format("issuer")} s FROM bills WHERE kind = 'purchase' AND bill_id % 9 <> 0 AND amount <> 0),
x AS (SELECT id, row_id FROM b JOIN r ON b.amount = r.amount WHERE least(len(s), len(t)) > 0 AND (len(list_intersect(s, t)) >= least(2, len(s), len(t)) OR len(list_intersect(s, p)) >= least(2, len(s), len(p)) AND len(p) > 0))
SELECT id, min(row_id) row_id FROM x GROUP BY id""",
)
def j14(spark, d):
    b = A.bank(spark, d).where("direction = 'DBIT'").select(F.col("txn_id").alias("id"), "amount", "party", "remittance")
    return M.first_compatible(b, positions(spark, d))


@query(
    "j15_live_rows",
    f"""SELECT i.bill_id id, arg_min(r.bill_id, (CASE WHEN len(list_intersect({WORDS.format("i.issuer")}, {WORDS.format("r.issuer")})) >= least(2, len({WORDS.format("i.issuer")}), len({WORDS.format("r.issuer")})) THEN 0 ELSE 1 END, r.bill_id)) row_id
 FROM (SELECT * FROM bills WHERE kind = 'purchase') i JOIN (SELECT * FROM bills WHERE kind = 'purchase' AND bill_id % 9 <> 0) r ON {NORM.format("i.number")} = {NORM.format("r.number")} AND i.amount = r.amount GROUP BY 1""",
)
def j15(spark, d):
    items = A.bills(spark, d).where("kind = 'purchase'").select(F.col("bill_id").alias("id"), lookup_key(F.col("number")).alias("number"), "amount", F.col("issuer").alias("supplier"))
    return M.live_rows(items, positions(spark, d))


NUMBER = r"trim(regexp_extract({0}, '(?i)\barve\s*(?:nr|number|no)?\.?\s*:?\s*([A-Z0-9._/-]{{2,}})', 1), ' .:-/')"


@query(
    "j16_payment_candidates",
    f""", r AS (SELECT bill_id row_id, {NORM.format("number")} AS number, amount, {PAID} paid FROM bills WHERE kind = 'purchase' AND bill_id % 9 <> 0),
b AS (SELECT txn_id id, {NORM.format(NUMBER.format("remittance"))} AS number, amount FROM bank WHERE direction = 'DBIT' AND {NUMBER.format("remittance")} <> ''),
local AS (SELECT {NORM.format("number")} AS number, amount FROM bills WHERE bill_id % 6 = 1)
SELECT id, min(row_id) row_id FROM b JOIN r ON r.number = b.number AND r.amount = b.amount WHERE r.paid::DOUBLE + 0.005 < r.amount AND id % 10 <> 3 AND NOT EXISTS (SELECT 1 FROM local l WHERE l.number = b.number AND l.amount = b.amount) GROUP BY id""",
)
def j16(spark, d):
    b = A.bank(spark, d).where("direction = 'DBIT'").withColumn("n", remittance_number(F.col("remittance"))).where("n <> ''")
    local = A.bills(spark, d).where("bill_id % 6 = 1").select(lookup_key(F.col("number")).alias("number"), "amount")
    rows = b.select(F.col("txn_id").alias("id"), lookup_key(F.col("n")).alias("number"), "amount")
    return M.payment_candidates(rows, rows.where("id % 10 = 3").select("id"), local, positions(spark, d))


@query("t19_remittance_numbers", f"SELECT txn_id, {NUMBER.format('remittance')} AS number FROM bank")
def t19(spark, d):
    return A.bank(spark, d).select("txn_id", remittance_number(F.col("remittance")).alias("number"))


@query(
    "m18_paid_fields",
    f"""{J8}, last AS (SELECT r bill_id, arg_max(b.amount, l) paid_amount, arg_max(b.booking_date, l) paid_date FROM matched JOIN bank b ON b.txn_id = l GROUP BY 1)
SELECT b.bill_id, CASE WHEN l.bill_id IS NOT NULL THEN 'paid' WHEN status = 'confirmed' AND b.bill_id % 2 = 0 THEN 'unmatched' WHEN b.bill_id % 2 = 0 THEN 'unknown' ELSE 'paid' END payment_status, CAST(paid_amount AS DOUBLE) paid_amount, paid_date
FROM bills b LEFT JOIN last l ON l.bill_id = b.bill_id WHERE status <> 'rejected'""",
)
def m18(spark, d):
    bills = A.bills(spark, d).where("status <> 'rejected'").withColumn("payment_status", F.when(F.col("bill_id") % 2 == 0, "unknown").otherwise("paid"))
    return doubles(M.paid_fields(bills, j8(spark, d), A.bank(spark, d)))


@query(
    "a23_statement_summary",
    """SELECT currency, direction, count(*) n, CAST(sum(amount) AS DOUBLE) total, CAST(sum(CASE direction WHEN 'DBIT' THEN -amount ELSE amount END) AS DOUBLE) net, min(booking_date) first_date, max(booking_date) last_date
 FROM bank GROUP BY ROLLUP (currency, direction)""",
)
def a23(spark, d):
    return doubles(M.statement_summary(A.bank(spark, d)))
