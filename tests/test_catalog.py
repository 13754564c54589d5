"""Every query of the catalogue against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from spanvec.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    rel = db.sql(catalog.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())
