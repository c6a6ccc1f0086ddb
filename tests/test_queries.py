"""Every registered query against its SQL in DuckDB, and the shape of its plan."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from reviewlens.plans import registry
from tools.check_oracles import TABLES, rows_of as normalized

from conftest import SF

registry.load()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
WITHOUT_SQL = {"jn13_resolved_devices", "txt1_chunks", "txt2_embedded_chunks", "txt3_vector_index", "txt5_knn_approx"}
PYTHON = ("jn11", "jn12", "jn13", "txt", "str2")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_but_the_listed_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = normalized(df.columns, df.collect())
    plan = re.sub(r"\(\d+\)", "", df._jdf.queryExecution().executedPlan().toString())
    assert not re.search(r"CartesianProduct|NestedLoopJoin", plan)
    if not name.startswith(PYTHON):
        assert not re.search(r"Python|InPandas", plan)
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == normalized(columns, cursor.fetchall())
    else:
        assert got


@pytest.mark.parametrize("name, scans", [("agg9_aspect_summary", 1), ("cmp1_compare_families", 1), ("cmp2_with_product_rollup", 1), ("rnk1_aspect_ranking", 1)])
def test_facts_are_scanned_once(spark, name, scans):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == scans


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["agg9_aspect_summary"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<l_partkey:bigint,l_returnflag:string>", plan)
    assert "o_orderkey" not in plan


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows[0]["ASPECT"] == "TOTAL" and rows[0]["REVIEW_COUNT"] == sum(r["REVIEW_COUNT"] for r in rows[1:])
