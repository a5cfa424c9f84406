"""Queries over whole tables: no id is left out, however large."""

import duckdb
import pytest

from postalloom import catalog
from tests.test_catalog import plain


@pytest.fixture
def wide(tmp_path):
    """A folder with tables whose ids go beyond every filter of the catalog."""
    tables = {
        "lineitem": "SELECT i AS l_orderkey, i % 97 AS l_suppkey, i % 89 AS l_partkey, 1 + i % 7 AS l_linenumber, (i % 50)::DOUBLE AS l_quantity FROM range(0, 4000) t(i)",
    }
    for name, rows in tables.items():
        duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_sparse_symmetric(spark, wide):
    found = catalog.QUERIES["sparse_symmetric"](spark, wide).toPandas()
    assert found["value"].sum() == 2 * sum(i % 50 for i in range(4000) if i % 50 >= 10)


def test_block_diag(spark, wide):
    found = catalog.QUERIES["block_diag"](spark, wide).toPandas()
    assert len(found) == 4000 and found["row"].max() <= 7 * 97
    assert plain(found) == plain(duckdb.sql(catalog.ORACLES["block_diag"].replace("FROM lineitem", f"FROM '{wide}/lineitem.parquet'")).df())


def test_admin_measure(spark, tmp_path):
    tables = {
        "customer": "SELECT i AS c_custkey, 'n' || i AS c_name, i % 5 AS c_nationkey, 's' || (i % 2) AS c_mktsegment, 0.0::DOUBLE AS c_acctbal FROM range(0, 600) t(i)",
        "nation": "SELECT i AS n_nationkey, 'c' || i AS n_name, i % 2 AS n_regionkey FROM range(0, 5) t(i)",
        "region": "SELECT i AS r_regionkey, 'p' || i AS r_name FROM range(0, 2) t(i)",
    }
    for name, rows in tables.items():
        duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    found = catalog.QUERIES["admin_measure"](spark, str(tmp_path)).toPandas()
    assert len(found) == 10 * 60 * 59 // 2 and found["id1"].max() == 589


def test_ngram_pairs_takes_all_suppliers(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT i AS s_suppkey, 'Supplier#' || lpad(i::VARCHAR, 9, '0') AS s_name FROM range(0, 600) t(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    found = catalog.QUERIES["ngram_pairs"](spark, str(tmp_path)).toPandas()
    grams = [{t[k : k + 3] for k in range(len(t) - 2)} for t in (f"Supplier#{i:09d}" for i in range(600))]
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8}
    assert len(found) == len(want) and set(zip(found["id1"], found["id2"])) == want and max(i for i, _ in want) >= 400
