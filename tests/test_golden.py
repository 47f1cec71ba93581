"""Expected values of single cases."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tallyspark.functions import dates, fields, numeric, text
from tallyspark.operators import alerts, allocation, ledger, matching, messages, upsert
from tallyspark.sources import files
from tallyspark.streaming import state


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


CHART = [
    (1, None, "3000", "revenue", -1, True, True), (1, 1, "5000", "material_cost", 1, True, True), (1, None, "5000", "labor_cost", 1, True, True), (1, None, "5100", "subcontractor_cost", 1, True, True),
    (1, None, "5200", "labor_cost", 1, True, True), (1, None, "5300", "overhead", 1, True, True), (1, None, "8888", "material_cost", 1, False, True), (1, None, "9999", "excluded", 1, True, True),
    (1, None, "7777", "revenue", 1, True, False), (2, None, "3000", "labor_cost", 1, True, True),
]


def chart(spark):
    return spark.createDataFrame(CHART, "organization_id int, integration_id int, account_code string, category string, sign int, included boolean, is_active boolean")


def financials(spark, rows, currency=None, start="2026-06-01", end="2026-06-30", overhead=True, months=False):
    """rows (account, amount, currency, date, organization of the batch) of project 26124, organization 1; see ledger.financials()."""
    full = [(k, 1, 1, a, Decimal(x), o, 1, None if d is None else dt.date.fromisoformat(d), c, 1, "26124", 123) for k, (a, x, c, d, o) in enumerate(rows)]
    cols = "batch_id long, line int, part long, account_code string, amount decimal(20,6), organization_id int, integration_id int, batch_date date, currency string, project_id long, dimension_code string, sync_run_id int"
    projects = spark.createDataFrame([(1, 1, "26124", "Torn", "active")], "project_id long, organization_id int, code string, name string, status string")
    f = ledger.month_series if months else ledger.financials
    return f(spark.createDataFrame(full, cols), projects, chart(spark), start, end, currency, overhead)


JUNE = ("EUR", "2026-06-15", 1)


def test_project_result(spark):
    r = financials(spark, [("3000", "-1000.123456", *JUNE), ("5000", "250.123456", *JUNE)]).first()
    assert (r.revenue, r.cost, r.result, r.margin, r.quality, r.warnings) == (Decimal("1000.123456"), Decimal("250.123456"), Decimal("750.000000"), 74.99, "complete", "")
    assert (r.n_batches, r.n_entries, r.n_allocations, r.runs) == (2, 2, 2, "123")
    assert financials(spark, [("5000", "1", "EUR", "2027-01-01", 1)]).first().quality == "no_data"
    r = financials(spark, [("5000", "100", *JUNE), ("5000", "-20", *JUNE)]).first()
    assert (r.cost, r.margin) == (80, None)


def test_overhead_and_routing(spark):
    rows = [("5100", "100", *JUNE), ("5200", "50", *JUNE), ("5300", "25", *JUNE)]
    assert [financials(spark, rows, overhead=o).first().cost for o in (True, False)] == [175, 150]
    r = financials(spark, [("7777", "10", *JUNE), ("9999", "20", *JUNE), ("8888", "30", *JUNE)]).first()
    assert (r.unclassified, r.excluded, r.cost, r.quality, r.warnings) == (10, 50, 0, "unclassified", "unclassified_amount_present")


def test_currencies(spark):
    """Several currencies leave nothing without a filter; one keeps blank rows, a filter leaves them out."""
    rows = [("5000", "10", *JUNE), ("5000", "20", "USD", "2026-06-15", 1), ("5000", "3", "", "2026-06-15", 1)]
    r = financials(spark, rows).first()
    assert (r.cost, r.n_allocations, r.quality, r.currencies, r.currency, r.warnings) == (0, 0, "mixed_currency", "EUR,USD", "", "mixed_currency")
    r = financials(spark, rows, currency="EUR").first()
    assert (r.cost, r.quality, r.currencies, r.currency) == (10, "complete", "EUR,USD", "EUR")
    r = financials(spark, [rows[0], rows[2]]).first()
    assert (r.cost, r.currency) == (13, "EUR")


def test_dates_codes_and_organizations(spark):
    r = financials(spark, [("5000", "100", *JUNE), ("5000", "5", "EUR", None, 1), ("5000", "7", "EUR", "2026-06-15", 2)]).first()
    assert (r.cost, r.warnings) == (100, "missing_batch_date:1")


def test_month_columns_hold_what_the_result_leaves_out(spark):
    r = {x.month.month: x for x in financials(spark, [("8888", "30", *JUNE), ("5000", "4", *JUNE)], start="2026-05-20", end="2026-06-30", months=True).collect()}
    assert (r[6].material_cost, r[6].cost, r[6].excluded) == (34, 4, 30) and (r[5].n_allocations, r[5].start) == (0, dt.date(2026, 5, 20))


def test_classification_falls_back(spark):
    rows = spark.createDataFrame([(1, 1, "5000"), (1, 2, "5000"), (1, 1, "1"), (1, 1, "7777"), (2, 1, "3000")], "organization_id int, integration_id int, account_code string")
    got = {(r.organization_id, r.integration_id, r.account_code): r.category for r in ledger.classify(rows, chart(spark)).collect()}
    assert got == {(1, 1, "5000"): "material_cost", (1, 2, "5000"): "labor_cost", (1, 1, "1"): "unclassified", (1, 1, "7777"): "unclassified", (2, 1, "3000"): "labor_cost"}


def test_months(spark):
    r = one(spark, m=dates.months_between_dates(F.lit("2024-02-10").cast("date"), F.lit("2024-03-05").cast("date")))["m"]
    assert [(x.start, x.end) for x in r] == [(dt.date(2024, 2, 10), dt.date(2024, 2, 29)), (dt.date(2024, 3, 1), dt.date(2024, 3, 5))]
    c = one(spark, c=dates.chunks(F.lit("2026-01-01").cast("date"), F.lit("2026-02-10").cast("date")))["c"]
    assert [(x.start.day, x.end.day) for x in c] == [(1, 31), (1, 10)]


def test_balanced_rounding(spark):
    rows = spark.createDataFrame([("g", i, 10000, 1) for i in (1, 2, 3)] + [("n", i, -1000, 1) for i in (1, 2, 3)] + [("r", 1, 10000, 75), ("r", 2, 10000, 25)], "g string, project_id long, source long, part long")
    got = {(r.g, r.project_id): (r.amount_cents, r.percent_10000) for r in allocation.balanced(rows, "g", "source", "part", ["project_id"]).collect()}
    assert [got["g", i][0] for i in (1, 2, 3)] == [3333, 3333, 3334]
    assert sum(got["n", i][0] for i in (1, 2, 3)) == -1000
    assert got["r", 1] == (7500, 750000)
    assert [got["g", i][1] for i in (1, 2, 3)] == [333333, 333333, 333334]


def test_numbers(spark):
    r = one(spark, a=numeric.normalize_amount(F.lit("1 234,56")), b=numeric.normalize_amount(F.lit("1.234,56")), us=numeric.normalize_amount(F.lit("1,234.56")), bad=numeric.parse_decimal(F.lit("x")), show=numeric.display_amount(F.lit(1234.565).cast("decimal(20,3)")))
    assert r == {"a": "1234.56", "b": "1234.56", "us": "1.23456", "bad": Decimal(0), "show": "1 234,57"}
    r = one(spark, **{k: numeric.payment_status(F.lit(t), F.lit(p)) for k, t, p in (("a", "10", "9.996"), ("b", "10", "4"), ("c", "10", ""), ("d", "x", "1"))})
    assert r == {"a": "paid", "b": "partially_paid", "c": "unpaid", "d": "unknown"}


def test_due_dates(spark):
    today = F.lit("2026-07-14").cast("date")  # a Tuesday
    r = one(spark, a=dates.due_date(F.lit("by 2026-07-20."), today), b=dates.due_date(F.lit("Palun homme"), today), c=dates.due_date(F.lit("by Tuesday"), today), d=dates.due_date(F.lit("none"), today))
    assert r == {"a": dt.date(2026, 7, 20), "b": dt.date(2026, 7, 15), "c": dt.date(2026, 7, 21), "d": None}


def test_texts(spark):
    r = one(
        spark,
        s=text.clean_subject(F.lit("RE: Fwd:  Invoice  7")),
        refs=text.reference_tokens(F.lit("Arve inv2026-104, order 77")),
        att=text.strong_attachments(F.lit("a.PDF; b.png;c.xlsx")),
        iban=text.find_ibans(F.lit("pay EE38 2200 2210 2014 5685")),
        codes=text.holds_code(F.lit("[26040] Plaza"), "26040"),
        longer=text.holds_code(F.lit("x126040"), "26040"),
        band=text.confidence_band(F.lit(80)),
        match=text.companies_match(text.company_tokens(F.lit("OÜ Põhja Ehitus")), text.company_tokens(F.lit("Põhja Ehitus OÜ"))),
    )
    assert r["s"] == "invoice 7" and r["refs"] == ["inv2026-104"] and r["att"] == ["a.PDF", "c.xlsx"]
    assert r["iban"] == ["EE382200221020145685"] and r["codes"] and not r["longer"] and r["band"] == "high" and r["match"]


def test_sentence_spans_and_candidates(spark):
    body = "Approved. There is delay risk.\nWork is blocked. Issue resolved.\nBest regards\nsignature approved"
    m = spark.createDataFrame([(1, body)], "message_id long, body string")
    got = {r.kind: r for r in messages.extract(m).collect()}
    assert set(got) == {"decision", "risk", "blocker", "resolution_evidence"}
    assert got["decision"].excerpt == "Approved." and got["decision"].start == 0 and got["decision"].end == 9


RULE = "rule_id int, type string, basis string, threshold double, threshold_percent double, grace_day int, scope string, statuses string"


def alert_facts(spark, rules, rows, today="2026-06-20", shares=()):
    projects = spark.createDataFrame([(1, "active")], "project_id long, status string")
    life, month = financials(spark, rows, start="1900-01-01", end=today), financials(spark, rows, start=today[:8] + "01", end=today)
    given = spark.createDataFrame([(1, Decimal(a), Decimal(b)) for a, b in shares], "project_id long, shared_in decimal(20,6), shared_out decimal(20,6)")
    return {r.rule_id: r for r in alerts.evaluate(spark.createDataFrame(rules, RULE), projects, life, month, given, today).collect()}


def test_alert_rules(spark):
    rows = [("3000", "-100", "EUR", "2026-06-15", 1), ("5000", "92", "EUR", "2026-06-15", 1)]
    rules = [(1, "margin_below", "accounting", None, 10.0, None, "all_with_activity", None), (2, "margin_below", "management", None, 10.0, 10, "all_with_activity", None), (3, "month_no_revenue", "accounting", 0.0, None, 30, "active_projects", None), (4, "month_negative", "accounting", 0.0, None, 25, "active_projects", None), (5, "lifetime_negative", "accounting", 0.0, None, 30, "active_projects", None), (6, "month_negative", "accounting", 0.0, None, None, "active_projects", "archived")]
    got = alert_facts(spark, rules, rows, shares=[("5", "0")])
    assert (got[1].evaluated, got[1].met, got[2].evaluated, got[2].met) == (8.0, True, 3.0, True)
    assert (got[3].met, got[3].skipped) == (False, None) and got[4].skipped == "grace_day_active:25" and (got[5].met, got[5].skipped) == (False, None) and 6 not in got
    mixed = alert_facts(spark, rules, [*rows, ("5000", "1", "USD", "2026-06-16", 1)])
    assert mixed[1].skipped == mixed[3].skipped == "skipped_mixed_currency"
    idle = alert_facts(spark, rules, [("5000", "50", "EUR", "2026-05-15", 1)])
    assert idle[3].skipped == "skipped_no_current_month_activity" and (idle[5].evaluated, idle[5].met) == (-50.0, True) and idle[1].skipped == "skipped_no_data"


def test_alert_transitions(spark):
    now = spark.createDataFrame([(1, 1, None, True), (1, 2, None, True), (1, 3, None, True), (1, 4, "skipped_no_data", None), (1, 5, None, False)], "rule_id int, project_id long, skipped string, met boolean")
    was = spark.createDataFrame([(1, 2, "dismissed"), (1, 3, "resolved"), (1, 5, "open"), (1, 6, "open")], "rule_id int, project_id long, status string")
    got = {r.project_id: (r.action, r.status) for r in alerts.transition(was, now).collect()}
    assert got == {1: ("opened", "open"), 2: ("unchanged", "dismissed"), 3: ("reopened", "open"), 4: ("skipped", None), 5: ("resolved", "resolved"), 6: ("unchanged", "open")}


def test_best_match_ties_and_company_words(spark):
    def side(rows, w):
        return matching.side(spark.createDataFrame([(i, Decimal(a), p, t, n) for i, a, p, t, n in rows], "id long, amount decimal(20,2), party string, text string, number string"), "id", "amount", "party", ["text"], "number")

    bank = side([(1, "10.00", "A Beta", "x", None), (2, "44.54", "Näide OÜ", "payment 2026-104", None)], matching.BANK_BILL)
    bills = side([(7, "10.01", "Gamma", "", "INV7"), (8, "10.00", "Delta", "", "INV8"), (9, "1.00", "näide oü", "", "2026-104")], matching.BANK_BILL)
    got = {r.l: (r.r, r.score, r.reasons) for r in matching.best_matches(bank, bills, matching.BANK_BILL).collect()}
    assert got == {1: (7, 50, "amount"), 2: (9, 65, "invoice_number; party")}
    ledger_rows, rows = side([(1, "44.54", "OU Esimene Ehitus", "", None)], matching.LEDGER_BANK), side([(5, "44.54", "ESIMENE EHITUS OU", "", None)], matching.LEDGER_BANK)
    r = matching.best_matches(ledger_rows, rows, matching.LEDGER_BANK).first()
    assert (r.score, r.reasons) == (80, "amount; party")


BILL = """
        Arve kuupäev: 26.03.2026
        Maksetähtaeg: 02.04.2026
        Registrikood: 12345678
        KMKR: EE123456789
        IBAN EE121010220034567890
        Käibemaks 24% 24,00
        Kokku tasuda 124,00 EUR
        """
FOOTER = """
        Tähtaeg 01.06.2026
        Vahesumma 4,52
        KM summa 1,08
        Kokku € (KM-ga) 5,60
        Arve on makstud.
        Näidis Elekter AS Registreerimisnr.: 10166316 Müügiesindused
        Karjavälja tn 6 KMKR: EE100427897
        IBAN: EE842200221001157980
        """


def test_bill_fields(spark):
    got = spark.createDataFrame([(1, BILL), (2, FOOTER)], "id int, t string").select("id", fields.extract(F.col("t"), "own").alias("f")).select("id", "f.*").orderBy("id").collect()
    a, b = got
    assert (a.invoice_date, a.due_date, a.issuer_reg_code, a.issuer_vat_no) == ("2026-03-26", "2026-04-02", "12345678", "EE123456789")
    assert (a.payment_details, a.vat_amount, a.amount_total) == ("EE121010220034567890", "24.00", "124.00")
    assert (b.issuer_name, b.issuer_reg_code, b.issuer_vat_no, b.payment_details) == ("Näidis Elekter AS", "10166316", "EE100427897", "EE842200221001157980")
    assert (b.vat_amount, b.amount_total, b.due_date) == ("1.08", "5.60", "2026-06-01")


def test_project_lines(spark):
    t = """
        AKT 05-32 Näide OÜ - (25200 - Uued ridamajad II / Mari) 6 20,00 120,00
        AKT 05-32 Näide OÜ - (26000 - Oru Kohvik ja Saal / 26070
        Mari)
        8 20,00 160,00
        """
    a, b = one(spark, x=fields.project_lines(F.lit(t)))["x"]
    assert (a.code, a.name, a.description) == ("25200", "Uued ridamajad II", "AKT 05-32 Näide OÜ - (25200 - Uued ridamajad II / Mari)")
    assert (a.quantity, a.price, a.net, b.code, b.name) == (6, 20, 120, "26000", "Oru Kohvik ja Saal")
    assert b.description == "AKT 05-32 Näide OÜ - (26000 - Oru Kohvik ja Saal / 26070 Mari)"
    r = one(spark, x=fields.project_lines(F.lit("Projekt: 26111 - Maja, x\nprojekt 26111\nobjekti viide 25001")))["x"]
    assert [(x.code, x.name) for x in r] == [("26111", "Maja"), ("25001", "25001")]


def test_mail_scores(spark):
    s = lambda *x: one(spark, s=fields.mail_score([F.lit(p) for p in x[:-1]], F.lit(x[-1])))["s"].score
    assert s("Arve 2026-104", "Tarnija OÜ", "Tere, manusena arve summas 122,00 EUR.", "arve-2026-104.pdf") >= 70
    assert s("Juuni uudiskiri", "Marketing", "Kampaania", "") < 45


def test_links(spark):
    m = spark.createDataFrame([(1, "[26040] Plaza"), (2, "x126040"), (3, "See 26-104."), (4, "26-1045"), (5, "the Atlas site")], "message_id long, t string")
    p = spark.createDataFrame([(7, "26040", "Atlas"), (8, "26-104", "Straße  <b>Nord</b>")], "project_id long, code string, name string")
    assert {(r.message_id, r.project_id) for r in messages.link_by_code(m, p, {"t": "code_subject"}).collect()} == {(1, 7), (3, 8)}
    assert {(r.message_id, r.project_id) for r in messages.link_by_name(m.union(spark.createDataFrame([(6, "an der STRASSE nord entlang")], m.schema)), p, ["t"]).collect()} == {(5, 7), (6, 8)}


def test_merge_roots(spark):
    links = [(1, 2), (2, 3), (5, 1), (70, 71), (71, 70), (72, 70), *((i, i + 1) for i in range(100, 140))]
    got = {r.node: (r.root, r.cyclic) for r in upsert.merge_roots(spark.createDataFrame(links, "node long, into long")).collect()}
    assert got == {**{i: (3, False) for i in (1, 2, 5)}, **{i: (None, True) for i in (70, 71, 72)}, **{i: (140, False) for i in range(100, 140)}}


def test_statement_file(spark, tmp_path):
    party = lambda role, n, i: f"<{role}><Nm>{n}</Nm></{role}><{role}Acct><Id><IBAN>{i}</IBAN></Id></{role}Acct>"
    tx = lambda n, r: f"<TxDtls><RltdPties>{party('Cdtr', n, 'EE1' + n)}</RltdPties><RmtInf><Ustrd>{r}</Ustrd><Ustrd>{r}</Ustrd><Ustrd>more</Ustrd></RmtInf></TxDtls>"
    entry = lambda inner: f"<Ntry><NtryRef>7</NtryRef><Amt Ccy='EUR'>12.50</Amt><CdtDbtInd>DBIT</CdtDbtInd><BookgDt><Dt>2026-01-02</Dt></BookgDt><ValDt><DtTm>2026-01-03T10:00:00</DtTm></ValDt><BkTxCd><Domn><Cd>PMNT</Cd></Domn></BkTxCd>{inner}</Ntry>"
    (tmp_path / "s.xml").write_text(f"<Document xmlns='urn:iso:std:iso:20022:tech:xsd:camt.053.001.02'><BkToCstmrStmt><Stmt><Acct><Id><IBAN>EE9</IBAN></Id></Acct>{entry('<NtryDtls>' + tx('A', 'x') + tx('B', 'y') + '</NtryDtls>')}{entry('')}</Stmt></BkToCstmrStmt></Document>")
    got = files.read_statements(spark, str(tmp_path / "s.xml")).orderBy("party").collect()
    assert [(r.party, r.party_iban, r.remittance) for r in got] == [("", "", ""), ("A", "EE1A", "x | more"), ("B", "EE1B", "y | more")]
    assert all((r.amount, r.currency, r.booking_date, r.value_date, r.account_iban, r.bank_tx_code, r.entry_ref) == (Decimal("12.5"), "EUR", dt.date(2026, 1, 2), dt.date(2026, 1, 3), "EE9", "PMNT", "7") for r in got)


def test_mail(spark):
    raw = spark.createDataFrame([(bytearray(b"Subject: Arve 1\r\nFrom: A <a@b.ee>\r\nTo: C <C@d.ee>\r\n\r\nhello"),), (None,)], "content binary")
    a, b = files.parse_mail(raw).collect()
    assert (a.subject, a.sender, a.recipients, a.body.strip()) == ("Arve 1", "a@b.ee", ["c@d.ee"], "hello") and b.subject is None


def test_csv_round_trip(spark, tmp_path):
    files.write_split(spark.createDataFrame([("1", "x"), ("2", "y")], "a string, bucket string"), str(tmp_path / "o"), "bucket")
    assert files.read_csv(spark, str(tmp_path / "o")).count() == 2


def test_payments(spark, tmp_path):
    import xml.etree.ElementTree as ET

    iban = "EE382200221020145685"
    rows = spark.createDataFrame([(1, "INV/7", "5,60", iban, "A & B", "2026-06-25", "EUR"), (2, "8", "0", iban, "A", "2026-06-01", "EUR"), (3, "9", "1", "EE38", "A", None, "EUR"), (4, "10", "2,345", iban, "C", "2026-06-01", "EUR")], "payment_id long, number string, amount string, iban string, party string, due_date string, currency string")
    blocks = files.payments(rows, "EE1", "Own <Co>", "2026-06-20")
    a, b, c, d = blocks.orderBy("payment_id").collect()
    assert (a.amount, a.execution_date, b.error, c.error, d.amount, d.execution_date) == (Decimal("5.60"), dt.date(2026, 6, 25), "amount", "iban", Decimal("2.35"), dt.date(2026, 6, 20))
    files.write_payments(blocks, str(tmp_path / "p"), message_id="AR 1", debtor_name="Own <Co>", created="2026-06-20T10:00:00")
    root = ET.fromstring("".join(f.read_text() for k in range(3) for f in sorted((tmp_path / "p" / f"part={k}").glob("part-*"))))
    text = [x.text for x in root.iter() if x.tag.endswith(("CtrlSum", "NbOfTxs", "MsgId", "EndToEndId", "Ustrd", "Nm", "ReqdExctnDt"))]
    assert text[:4] == ["AR-1", "2", "7.95", "Own Co"] and "A & B" in text and "Arve INV/7" in text and "INV-7" in text and text.count("Own Co") == 3
    with pytest.raises(ValueError):
        files.payments(rows, "", "Own", "2026-06-20")


def test_outer_formats(spark, tmp_path):
    raw = spark.createDataFrame([('{"Dimensions": [{"Id": "1", "Values": [{"DimValueId": "a", "Code": "25001", "Name": "x"}]}]}',), ('[{"DimId": "2", "Values": [{"Id": "b", "DimValueCode": "25002"}]}, {"Id": "3"}]',)], "json string")
    assert sorted(map(tuple, files.flatten_dimensions(raw).collect())) == [("1", "a", "25001", "x"), ("2", "b", "25002", "")]
    x = spark.createDataFrame([(1, "<a:E xmlns:a='u'><a:InvoiceSum>1 234,50</a:InvoiceSum><a:totalsum> </a:totalsum><VATSUM>2,00</VATSUM><IssueDate>05.03.26</IssueDate><IBAN>EE1 2</IBAN></a:E>")], "id int, x string")
    r = files.e_invoice(x, "x", "id").first()
    assert (r.amount_total, r.vat_amount, r.invoice_date, r.payment_details, r.due_date) == ("1234.50", "2.00", "2026-03-05", "EE12", "")
    rows = spark.createDataFrame([(i, f"n{i % 3}") for i in range(9)], "a int, b string")
    files.write_register(rows, str(tmp_path / "r"), ["b", "a"])
    got = [line for f in sorted((tmp_path / "r").glob("part-*")) for line in f.read_text().splitlines()[1:]]
    assert got == sorted(got, key=lambda x: (x.split(",")[1], int(x.split(",")[0])))
    files.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 9


def test_alert_stream(spark, tmp_path):
    rows = [("a", 1, "yes"), ("a", 2, "yes"), ("a", 3, "no"), ("a", 4, "yes"), ("a", 5, "dismiss"), ("a", 6, "yes")]
    spark.createDataFrame(rows, "fingerprint string, seq long, met string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fingerprint string, seq long, met string").parquet(str(tmp_path / "in"))
    got = state.run_to_table(state.alert_life(stream), str(tmp_path / "run")).orderBy("n_seen").collect()
    assert [r.action for r in got] == ["opened", "updated", "resolved", "reopened", "dismissed", "unchanged"]
