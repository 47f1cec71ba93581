"""Fields of bills: each value is computed once, and XML is read once a bill."""

import time

from pyspark.sql import functions as F
from tallyspark.functions import fields as X
from tallyspark.sources import files


def depth(column) -> int:
    return len(column._jc.toString())


def test_one_expression_a_value(spark):
    """Plans don't repeat an amount for each of its uses: the gross amount is little larger than its parts."""
    t = F.col("t")
    total, vat = X.labelled_amount(t, X.TOTAL_LABELS), X.labelled_amount(t, X.VAT_LABELS, vat=True)
    assert depth(X.gross_amount(t, total, vat)) < 2 * (depth(total) + depth(vat))
    parts = depth(X.issuer_name(t, "own")) + depth(X.account_number(t)) + depth(X.date_near_number(t)) + 2 * depth(total) + 2 * depth(vat)
    assert depth(X.extract(t, "own")) < 4 * parts


def test_gross_of_many_amounts(spark):
    """2,000 lines of amounts take a moment, and the gross amount stands among them."""
    text = "Summa kokku 100,00\nKM 24% 24,00\n" + "\n".join(f"rida {i},11" for i in range(2000)) + "\n124,00"
    rows = spark.createDataFrame([(text,)] * 50, "t string")
    start = time.time()
    got = rows.select(X.gross_amount(F.col("t"), X.labelled_amount(F.col("t"), X.TOTAL_LABELS), X.labelled_amount(F.col("t"), X.VAT_LABELS, vat=True)).alias("g")).collect()
    assert {r.g for r in got} == {"124.00"} and time.time() - start < 30


def test_bills_in_xml_are_read_once(spark):
    """No XPath of the plan reads a bill anew; a blank tag, a nested text and a missing bill are as by XPath."""
    rows = [(1, "<E><TOTALSUM> </TOTALSUM><a><TotalSum>1<b>2</b>,50</TotalSum></a><iban><x/>EE1</iban></E>"), (2, None)]
    out = files.e_invoice(spark.createDataFrame(rows, "id int, x string"), "x", "id")
    assert "xpath" not in out._jdf.queryExecution().toString().lower()
    got = {r.id: r for r in out.collect()}
    assert (got[1].amount_total, got[1].payment_details) == ("12.50", "EE1") and (got[2].amount_total, got[2].due_date) == ("", "")
