"""Percents of a thousand and more."""

from oracle import difference
from pyspark.sql import functions as F
from tallyspark.functions import numeric as N
from tallyspark.plans.queries import QUERIES, SQL


def test_large_percents(spark):
    """The query equals its SQL where percents pass 1,000; the function groups unless told not to."""
    assert difference(spark, QUERIES["n9_percents"], SQL["n9_percents"], "/root/testdata/sf0.1") is None
    c = F.lit("1234.565").cast("decimal(20,3)")
    assert tuple(spark.range(1).select(N.display_percent(c), N.display_percent(c, grouping=False)).first()) == ("1 234,57%", "1234,57%")
