"""Every ledger query against its SQL; the rest against counts that follow from the tables."""

import pytest
from oracle import difference
from tallyspark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], SF) is None


def test_rows_without_sql(spark):
    assert QUERIES["t24_extracted_candidates"](spark, SF).count() > 0
    bills = {r.bill_id: r for r in QUERIES["t14_t16_extracted_fields"](spark, SF).collect()}
    for i, r in bills.items():
        if i % 4 == 0:
            assert (r.invoice_date, r.due_date, r.issuer_reg_code, r.issuer_vat_no) == ("1996-03-05", "2096-03-19", f"1{i:07d}", f"EE1{i:08d}") and r.issuer_name.endswith(" OÜ")
        if i % 4 == 1:
            assert r.invoice_date == "1996-04-12" and r.vat_amount == "1234.56"
    lines = QUERIES["t17_project_lines"](spark, SF).groupBy("bill_id").count().collect()
    assert {r["count"] for r in lines} == {2} and {r.bill_id % 4 for r in lines} == {3}


def test_entry(spark):
    import __spark_entry__ as e

    assert "revenue" in e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
