import os

import duckdb
import pytest

from keyloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name != "findings_documents":
        assert len(got)
    if name in catalog.oracle_sql():
        con = duckdb.connect()
        for t in os.listdir(SF):
            con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
        assert _rows(got) == _rows(con.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
