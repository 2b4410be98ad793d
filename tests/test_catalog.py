"""Every catalog query against its SQL on the small tables; the rest give rows."""

import glob
import os

import duckdb
import pytest

from strandlake.jobs import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"overlap_balance", "control_models"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(frame, columns):
    own = frame[columns].astype(object)
    rows = own.where(own.notna(), None).itertuples(index=False, name=None)
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no tables")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.SQL:
        assert len(got)
        return
    want = db.sql(catalog.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got, columns) == plain(want, columns)
