"""Registered queries do the whole job: tested recall, and no part of a table left out."""

import duckdb
import pytest

from spanvec.operators.knn import nearest
from spanvec.plans import catalog

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.mark.parametrize("sf", [SF, LARGE])
@pytest.mark.parametrize("name,where", [("ivf_knn_l2", "true"), ("ivf_knn_filtered", "label < 8")])
def test_index_queries_reach_the_recall(spark, sf, name, where):
    rows = catalog.table(spark, sf, "embeddings").where(where)
    want = {r.vec_id for r in nearest(rows, "embedding", catalog.vector(spark, sf), 10, key="vec_id").collect()}
    assert len(want & {r.vec_id for r in catalog.QUERIES[name](spark, sf).collect()}) >= 0.9 * len(want)


@pytest.mark.parametrize(
    "name,sql",
    [
        ("join_range", "SELECT p_partkey, s_suppkey FROM part, supplier WHERE s_suppkey - p_partkey IN (0, 1, 2)"),
        ("join_full", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT NULL, s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)"),
        ("set_except", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
    ],
)
def test_host_queries_read_whole_tables(spark, name, sql):
    db = duckdb.connect()
    for t in ("part", "supplier", "customer", "nation"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{LARGE}/{t}.parquet'")
    assert sorted(map(str, map(tuple, catalog.QUERIES[name](spark, LARGE).collect()))) == sorted(map(str, db.sql(sql).fetchall()))
