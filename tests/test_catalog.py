import pytest
from oracle import rows_of, sql_rows

from inkgraph.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = rows_of(catalog.QUERIES[name](spark, SF))
    if name in catalog.SQL:
        assert got == sql_rows(catalog.SQL[name], SF)
    else:
        assert got[1]


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_claim_by_hand(spark):
    from inkgraph.operators.ensemble import claim

    rows = [(1, 0, 0, 0, 0, 100, 100, 0.5), (1, 1, 0, 2, 0, 100, 100, 0.9), (1, 2, 0, 50, 0, 150, 100, 0.7), (2, 1, 0, 0, 0, 100, 100, 0.1), (1, 2, 1, 0, 0, 100, 85, 0.9)]
    df = spark.createDataFrame(rows, "page_no int, run_id int, record_ord int, x1 int, y1 int, x2 int, y2 int, confidence double")
    got = {(r.page_no, r.run_id, r.record_ord) for r in claim(df, ["page_no"]).collect()}
    # run 1 is claimed by run 0 and is the more confident; the overlap of the third is small, the fourth is on another page, the fifth's height differs
    assert got == {(1, 1, 0), (1, 2, 0), (2, 1, 0), (1, 2, 1)}
