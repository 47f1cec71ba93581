"""What a change brings is computed once, though its buckets are looked up before its rows are merged."""

from tallyspark.operators import increments


def test_a_change_is_computed_once(spark, tmp_path):
    seen, names = spark.sparkContext.accumulator(0), [c.split()[0] for c in increments.CELL.split(", ")]

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(50).selectExpr("id project_id", "1 organization_id", "1 integration_id", "'3000' account_code", "'EUR' currency", "date'1995-01-01' batch_date", "cast(id as decimal(30,6)) amount", "1L n").select(*names)
    cells = increments.table(spark, f"file://{tmp_path}/cells", 4)
    increments.apply(cells, rows.mapInArrow(each, increments.CELL), 0)
    assert cells.rows().count() == 50 and seen.value == 50
