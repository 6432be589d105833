import pytest
from pyspark.sql import functions as F

from scenlens.functions import (
    absent_as_zero,
    alnum_piece,
    choose,
    contains,
    half_even,
    not_in_nor_null,
    number_text,
    ordinal,
    patch,
    recode_first,
    recode_last,
    safe_div,
    separator_piece,
    split_decile,
    split_last,
    strict_avg,
    strict_sum,
    strict_sum_where,
    sum0,
)
from scenlens.scenarios import NO_POLICY, POLICY, POLICY_EXACT
from tests.helpers import one, rows, table


@pytest.fixture(scope="module")
def gaps(spark):
    return table(spark, [("a", 1.0), ("a", None), ("a", 2.0), ("b", 3.0), ("c", None), ("c", None)], "k string, v double")


def test_strict_sum_is_null_with_one_gap(gaps):
    assert rows(gaps.groupBy("k").agg(strict_sum("v"))) == [("a", None), ("b", 3.0), ("c", None)]


def test_sum0_skips_gaps_and_gives_zero(gaps):
    assert rows(gaps.groupBy("k").agg(sum0("v"))) == [("a", 3.0), ("b", 3.0), ("c", 0.0)]


def test_strict_avg(gaps):
    assert rows(gaps.groupBy("k").agg(strict_avg("v"))) == [("a", None), ("b", 3.0), ("c", None)]


def test_strict_sum_where_tells_neither_absent_nor_gap_as_a_number(gaps):
    got = one(gaps.agg(
        strict_sum_where(F.col("k") == "b", "v").alias("b"), strict_sum_where(F.col("k") == "a", "v").alias("a"),
        strict_sum_where(F.col("k") == "z", "v").alias("z")))
    assert got == (3.0, None, None)


def test_negated_contains_keeps_missing_text(spark):
    df = table(spark, [("coal",), ("wind",), (None,)], "t string")
    assert set(rows(df.where(~contains("t", "coal")))) == {("wind",), (None,)}


@pytest.mark.parametrize("pattern, hits", [("oil|gas", 2), ("^a", 1), ("a.c", 1), ("b", 0)])
def test_contains_plain_and_regular(spark, pattern, hits):
    df = table(spark, [("a oil",), ("natural gas",), ("x-aXc",)], "t string")
    assert df.where(contains("t", pattern)).count() == hits


def test_not_in_list_drops_missing(spark):
    df = table(spark, [("x",), ("y",), (None,)], "t string")
    assert rows(df.where(not_in_nor_null("t", ["x"]))) == [("y",)]


def test_division_by_zero_is_null(spark):
    df = table(spark, [(1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, None, 1.5, None]


def test_half_even(spark):
    df = table(spark, [(2.5,), (3.5,), (-0.5,), (0.125,)], "x double")
    assert [r[0] for r in df.select(half_even("x")).collect()] == [2.0, 4.0, 0.0, 0.0]
    assert [r[0] for r in df.select(half_even("x", 2)).collect()][-1] == 0.12


@pytest.mark.parametrize("value, digits, text", [
    (61.0, 1, "61"), (-0.04, 1, "0"), (2.5, 1, "2.5"), (1234.56, 1, "1234.6"), (100.0, 0, "100"), (-0.4, 0, "0"),
    (2.0, 2, "2"), (-1.25, 1, "-1.2"), (10.0, 1, "10"), (None, 1, None), (float("nan"), 1, None),
])
def test_number_text(spark, value, digits, text):
    assert one(table(spark, [(value,)], "x double").select(number_text("x", digits))) == text


def test_choose_passes_missing_condition(spark):
    df = table(spark, [(-1.0,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(choose(F.col("x") < 0, 0.0, F.col("x"))).collect()] == [0.0, 1.0, None]


def test_absent_as_zero(spark):
    df = table(spark, [(None,), (float("nan"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(absent_as_zero("x")).collect()] == [0.0, 0.0, 2.0]


def test_scenario_rules(spark):
    labels = ["RegGHGPol_Ineq", "RegGHGPol_Gini25_Ineq", "RegGHGPol_Gini50_Ineq", "x_RegGHGPol_Ineq", "other", None]
    df = table(spark, [(v,) for v in labels], "scenario string")
    got = [r[0] for r in df.select(POLICY.canonical()).collect()]
    assert got == ["Baseline", "Gini25", "Gini50", "Baseline", "other", None]
    exact = [r[0] for r in df.select(POLICY_EXACT.canonical()).collect()]
    assert exact == ["Baseline", "Gini25", "Gini50", "x_RegGHGPol_Ineq", "other", None]


def test_scenario_suffix(spark):
    df = table(spark, [("Ref_SSP2_Ineq",), ("Ref_SSP2_Gini25_Ineq",)], "scenario string")
    got = [r[0] for r in df.select(NO_POLICY.levels(NO_POLICY.canonical())).collect()]
    assert got == ["Baseline_NoClimPol", "Gini25_NoClimPol"]


def test_first_and_last_rule_win(spark):
    df = table(spark, [("a b",), ("b",), ("z",)], "t string")
    rules = [("has", "a", "A"), ("has", "b", "B")]
    assert [r[0] for r in df.select(recode_first("t", rules)).collect()] == ["A", "B", "z"]
    assert [r[0] for r in df.select(recode_last("t", rules)).collect()] == ["B", "B", "z"]
    assert [r[0] for r in df.select(recode_first("t", rules, F.lit("?"))).collect()] == ["A", "B", "?"]
    with pytest.raises(ValueError):
        recode_first("t", [("like", "a", "A")])


def test_ordinal(spark):
    df = table(spark, [("lo",), ("hi",), ("?",), (None,)], "t string")
    assert [r[0] for r in df.select(ordinal("t", ["lo", "hi"])).collect()] == [1, 2, None, None]


def test_patch_only_named_cells(spark):
    df = table(spark, [("a", 1, 5.0), ("a", 2, 5.0), (None, 1, 5.0)], "r string, y int, v double")
    got = [r[0] for r in df.select(patch("v", [({"r": "a", "y": 1}, 0)])).collect()]
    assert got == [0.0, 5.0, 5.0]


LABELS = ["trn_pass_d1", "trn_aviation_intl", "noscore", "a_b_c", "resid heating modern_d10", "x_d", "_d2", "", None]


def test_split_last(spark):
    df = table(spark, [(v,) for v in LABELS], "t string")
    left, right = split_last("t")
    assert [tuple(r) for r in df.select(left, right).collect()] == [
        ("trn_pass", "d1"), ("trn_aviation", "intl"), ("noscore", None), ("a_b", "c"),
        ("resid heating modern", "d10"), ("x", "d"), ("", "d2"), ("", None), (None, None)]


def test_split_decile_takes_only_deciles(spark):
    df = table(spark, [(v,) for v in LABELS], "t string")
    left, right = split_decile("t")
    assert [tuple(r) for r in df.select(left, right).collect()] == [
        ("trn_pass", "d1"), ("trn_aviation_intl", None), ("noscore", None), ("a_b_c", None),
        ("resid heating modern", "d10"), ("x_d", None), ("", "d2"), ("", None), (None, None)]


def test_pieces(spark):
    df = table(spark, [("Food Demand, Group1",), ("a",), ("a_",), ("_a",), (None,)], "t string")
    picked = [tuple(r) for r in df.select(*[alnum_piece("t", n) for n in (1, 2, 3, 4)]).collect()]
    assert picked == [
        ("Food", "Demand", "Group1", None), ("a", None, None, None), ("a", "", None, None), ("", "a", None, None),
        (None, None, None, None)]
    assert [r[0] for r in df.select(separator_piece("t", "_", 2)).collect()] == [None, None, "", "a", None]
