"""Registered queries against DuckDB, and the shape of their physical plans."""

import re

import pytest

import __spark_entry__ as entry
from testbed.check import compare, oracle_connection
from testbed.registry import ENTRIES

QUERIES = {n: q for n, q in entry.queries().items() if n in ENTRIES}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return oracle_connection(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) and len(QUERIES) == len(ENTRIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, oracle, sf_dir, name):
    verdict, n, detail = compare(spark, oracle, QUERIES[name], SQL.get(name), sf_dir)
    assert verdict == "ok", detail
    assert n > 0


def plan(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    return df._jdf.queryExecution().executedPlan().toString()


FILE_QUERIES = {n for n in QUERIES if re.match(r"[sk]\d", n)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FILE_QUERIES))
def test_plan_stays_in_the_jvm_without_cartesian_products(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert node not in text


def test_flagship_scan_is_narrow_and_filtered(spark, sf_dir):
    text = plan(spark, sf_dir, "q_diff_baseline")
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert re.search(r"ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate", text)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "sector", "Units", "scenario", "value"] and df.count() > 0
