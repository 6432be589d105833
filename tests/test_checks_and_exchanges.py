"""Checks that no later filter moves below, presence from the cells' own exchange, and how often inputs are read."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scenlens.operators import compare, strict_lookup
from scenlens.operators.compare import net_and_relative, spread
from scenlens.scenarios import POLICY
from scenlens.sources.files import read_csv
from tests.helpers import message_of, rows, table

RUNS = ("RegGHGPol_Ineq", "RegGHGPol_Gini25_Ineq", "RegGHGPol_Gini50_Ineq")
SCHEMA = "scenario string, region string, year int, value double"


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_row_that_a_later_filter_takes_out_is_checked(spark):
    left = table(spark, [("a", 1), ("b", 2)], "k string, v int")
    right = table(spark, [("a", "x")], "k string, w string")
    assert "no match" in message_of(strict_lookup(left, right, ["k"]).where(F.col("v") == 1))
    assert rows(strict_lookup(left.where(F.col("v") == 1), right, ["k"])) == [("a", 1, "x")]


@pytest.mark.parametrize("cells", ["summed", "merged", "single"])
def test_an_absent_scenario_fails_whatever_is_filtered_later(spark, cells):
    df = table(spark, [(RUNS[0], "A", 2020, 1.0), (RUNS[1], "A", 2020, 2.0), (RUNS[0], "B", 2030, 1.0)], SCHEMA)
    for later in (F.col("year") == 2020, F.col("region") == "nowhere", F.col("value") > 5):
        assert "Gini50" in message_of(compare(df, ["region", "year"], POLICY, cells=cells).where(later))
    assert "Gini50" in message_of(net_and_relative(df, ["year"], ["region"], POLICY).where(F.col("year") == 2020))


def test_presence_adds_no_row_and_an_empty_table_passes(spark):
    df = table(spark, [(r, reg, 2020, 1.0 + i) for i, r in enumerate(RUNS) for reg in ("A", None)], SCHEMA)
    assert rows(spread(df, ["region", "year"], POLICY)) == [("A", 2020, 1.0, 2.0, 3.0), (None, 2020, 1.0, 2.0, 3.0)]
    assert rows(spread(df.where("region = 'A'"), [], POLICY)) == [(1.0, 2.0, 3.0)]
    assert rows(spread(df.limit(0), ["region", "year"], POLICY)) == []


def test_a_comparison_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "in")
    table(spark, [(r, "A", 2020, 1.0) for r in RUNS], SCHEMA).write.parquet(path)
    for df in (compare(spark.read.parquet(path), ["region", "year"], POLICY),
               net_and_relative(spark.read.parquet(path), ["year"], ["region"], POLICY)):
        plan = executed(df)
        assert plan.count("FileScan") == 1 and "Subquery" not in plan


@pytest.mark.parametrize("name, most", [("n16_final_energy_change", 5), ("n24_decile_energy_change", 8), ("n54_adequacy", 12)])
def test_exchanges_of_the_wide_results(spark, sf_dir, name, most):
    plan = executed(entry.queries()[name](spark, sf_dir))
    assert len(re.findall(r"(?<!Reused)Exchange (?:hash|Single|round|range)", plan)) <= most


def test_a_header_is_read_without_a_job(spark, tmp_path):
    for i, text in enumerate(("# note\n\nb,a\n1,x\n", "# note\nb,a\n2,y\n")):
        (tmp_path / f"{i}.csv").write_text(text)
    (tmp_path / "_SUCCESS").write_text("")
    status, before = spark.sparkContext.statusTracker(), set()
    spark.sparkContext.setJobGroup("header", "header")
    df = read_csv(spark, str(tmp_path), "a string, b int", comment="#")
    assert set(status.getJobIdsForGroup("header")) == before
    spark.sparkContext.setJobGroup("rest", "rest")
    assert rows(df) == [("x", 1), ("y", 2)]
    few = read_csv(spark, str(tmp_path), "a string, b int", comment="#", every_field=False).select("b")
    assert rows(few) == [(1,), (2,)] and "ReadSchema: struct<b:string>" in executed(few)
    (tmp_path / "2.csv").write_text("a,b\nz,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path), "a string, b int", comment="#").collect()
