import itertools
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenlens.constants import DECILES
from scenlens.functions import alnum_piece
from scenlens.operators import (
    annual_series,
    compare,
    cross_with,
    decile_gini,
    decile_shares,
    fit_line,
    fixed_class,
    gap_to_target,
    inline_table,
    kmeans_class,
    lookup,
    net_and_relative,
    palma,
    pivot_cells,
    pivot_sums,
    pretty_class,
    share_of_group,
    split_equally,
    spread,
    strict_lookup,
    to_aggregate_region,
    to_long,
    union_all,
    unmatched,
    verified_key,
    with_group_total,
    year_window,
)
from scenlens.scenarios import POLICY
from tests.helpers import message_of, one, rows, table

RAW = {"Baseline": "RegGHGPol_Ineq", "Gini25": "RegGHGPol_Gini25_Ineq", "Gini50": "RegGHGPol_Gini50_Ineq"}

# ---- joins ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def facts(spark):
    return table(spark, [("a", 1.0), ("b", 2.0), ("b", 3.0)], "k string, v double")


def test_lookup_keeps_every_row(spark, facts):
    names = inline_table(spark, [("a", "A"), ("b", "B"), ("c", "C")], "k string, name string")
    assert rows(strict_lookup(facts, names, ["k"])) == [("a", 1.0, "A"), ("b", 2.0, "B"), ("b", 3.0, "B")]


def test_lookup_fails_without_match_even_if_the_column_is_unused(spark, facts):
    names = inline_table(spark, [("a", "A")], "k string, name string")
    assert "no match" in message_of(strict_lookup(facts, names, ["k"]))
    assert "no match" in message_of(strict_lookup(facts, names, ["k"]).agg(F.count(F.lit(1))))
    assert rows(unmatched(facts, names, ["k"])) == [("b",)]


def test_lookup_fails_on_a_doubled_key(spark, facts):
    names = inline_table(spark, [("a", "A"), ("b", "B"), ("b", "B2")], "k string, name string")
    assert "several matches" in message_of(strict_lookup(facts, names, ["k"]))


def test_lookup_with_missing_keys(spark):
    left = table(spark, [("x", None), ("x", "d1")], "r string, d string")
    right = table(spark, [("x", None, 1.0), ("x", "d1", 2.0)], "r string, d string, p double")
    got = rows(strict_lookup(left, right, ["r", "d"]))
    assert set(got) == {("x", None, 1.0), ("x", "d1", 2.0)}


def test_key_checked_once(spark):
    names = verified_key(table(spark, [("a", "A"), ("b", "B")], "k string, name string"), ["k"])
    assert names.verified_key == ("k",)
    with pytest.raises(ValueError):
        verified_key(table(spark, [("a", "A"), ("a", "B")], "k string, name string"), ["k"])
    with pytest.raises(ValueError):
        inline_table(spark, [("a", 1), ("a", 2)], "k string, n int", ["k"])


def test_lookup_on_a_label_adds_no_filter_below_the_sum(spark, tmp_path):
    """A key read out of a label must not be tested for NULL on every raw row."""
    table(spark, [("x_d1", 1.0), ("x_d2", 2.0)], "label string, value double").write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    right = raw.groupBy("label").agg(F.sum("value").alias("value")).select(alnum_piece("label", 2).alias("d"), "value")
    joined = lookup(table(spark, [("d1",), ("d3",)], "d string"), right, ["d"])
    assert set(rows(joined)) == {("d1", 1.0), ("d3", None)}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp_replace" in line]


def test_cross_with(spark, facts):
    assert cross_with(facts, s=("x", "y"), n=(1, 2)).count() == 12


def test_region_roll_up(spark):
    regions = inline_table(spark, [("a", "A"), ("b", "A"), ("c", "C")], "region string, region_agg string")
    df = table(spark, [("a", 1, 1.0), ("b", 1, 2.0), ("a", 2, 1.0), ("b", 2, None), ("c", 1, 5.0)], "region string, year int, value double")
    assert rows(to_aggregate_region(df, regions, ["region", "year"])) == [("A", 1, 3.0), ("A", 2, None), ("C", 1, 5.0)]


def test_group_total_with_missing_group_key(spark):
    df = table(spark, [(None, 1.0), (None, 3.0), ("a", 4.0)], "k string, v double")
    assert set(rows(with_group_total(df, ["k"], "v", "t"))) == {(None, 1.0, 4.0), (None, 3.0, 4.0), ("a", 4.0, 4.0)}


# ---- reshape and comparison --------------------------------------------------------


def scenario_rows(spark, cells):
    return table(spark, [(RAW[s], *k, v) for s, *k, v in cells], "scenario string, year int, sector string, value double")


def test_pivot_cells_refuses_doubles(spark):
    df = table(spark, [("x", "a", 1.0), ("x", "a", 1.0)], "id string, n string, value double")
    assert "DuplicateCell" in message_of(pivot_cells(df, ["id"], "n", ["a", "b"]))
    assert rows(pivot_sums(df, ["id"], "n", ["a", "b"])) == [("x", 2.0, None)]


def test_to_long_keeps_gaps(spark):
    df = table(spark, [("x", 1.0, None)], "id string, a double, b double")
    assert rows(to_long(df, ["id"], None, "n", "v")) == [("x", "a", 1.0), ("x", "b", None)]


def test_union_fills_missing_columns(spark):
    a, b = table(spark, [(1, "x")], "n int, t string"), table(spark, [(2,)], "n int")
    assert set(rows(union_all(a, b))) == {(1, "x"), (2, None)}


def test_year_window(spark):
    df = table(spark, [(2015,), (2016,), (2050,), (2051,), (None,)], "year int")
    assert rows(year_window(df)) == [(2016,), (2050,)]


@pytest.mark.parametrize("kind, want", [
    ("abs", {"Gini25": 2.0, "Gini50": -1.0}), ("fraction", {"Gini25": 0.5, "Gini50": -0.25}),
    ("percent", {"Gini25": 50.0, "Gini50": -25.0}), ("ratio", {"Gini25": 1.5, "Gini50": 0.75}),
])
def test_compare_kinds(spark, kind, want):
    df = scenario_rows(spark, [
        ("Baseline", 2020, "s", 1.0), ("Baseline", 2020, "s", 3.0), ("Gini25", 2020, "s", 6.0), ("Gini50", 2020, "s", 3.0)])
    got = {r["scenario"]: r["value"] for r in compare(df, ["year", "sector"], POLICY, kind).collect()}
    assert got == want


def test_compare_without_a_cell_or_with_zero_baseline(spark):
    df = scenario_rows(spark, [("Baseline", 2020, "s", 0.0), ("Gini25", 2020, "s", 6.0), ("Gini50", 2030, "s", 1.0)])
    got = {r["scenario"]: r["value"] for r in compare(df, ["year", "sector"], POLICY, "percent").where("year = 2020").collect()}
    assert got == {"Gini25": None, "Gini50": None}


def test_compare_single_cells_refuses_doubles(spark):
    df = scenario_rows(spark, [(n, 2020, "s", 1.0) for n in ("Baseline", "Baseline", "Gini25", "Gini50")])
    assert "DuplicateCell" in message_of(compare(df, ["year", "sector"], POLICY, cells="single"))


def test_gap_to_target(spark):
    df = table(spark, [("r", 10.0, 12.0, 9.0)], "region string, target double, A double, B double")
    assert rows(gap_to_target(df, "target", {"first": "A", "second": "B"}, ["region"], "gap")) == [
        ("r", "first", -2.0), ("r", "second", 1.0)]


def test_net_and_relative_treats_an_absent_cell_differently(spark):
    df = scenario_rows(spark, [
        ("Baseline", 2020, "s", 4.0), ("Gini25", 2020, "s", 5.0), ("Gini50", 2020, "s", 3.0),
        ("Baseline", 2020, "t", 4.0), ("Gini25", 2020, "t", 5.0)])
    got = {r["scenario"]: (r["total_value"], r["annual_change"]) for r in net_and_relative(df, ["year"], ["sector"], POLICY).collect()}
    assert got == {"Gini25": (2.0, 25.0), "Gini50": (None, -62.5)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(list(RAW)), st.integers(0, 3), st.one_of(st.none(), st.integers(-50, 50))), min_size=1, max_size=40))
def test_spread_matches_brute_force(spark, data):
    data = [*data, *[(s, 9, 1) for s in POLICY.names]]  # no scenario is wholly absent
    df = table(spark, [(RAW[s], y, None if v is None else float(v)) for s, y, v in data], "scenario string, year int, value double")
    want = {}
    for y in {y for _, y, _ in data}:
        cell = []
        for s in POLICY.names:
            values = [v for s2, y2, v in data if s2 == s and y2 == y]
            cell.append(None if not values or None in values else float(sum(values)))
        want[y] = tuple(cell)
    assert {r["year"]: tuple(r)[1:] for r in spread(df, ["year"], POLICY).collect()} == want


# ---- interpolation ---------------------------------------------------------------


def series(spark, data):
    return table(spark, data, "k string, year int, value double")


def test_interpolation_fixture(spark):
    df = series(spark, [("a", 2025, 10.0), ("a", 2030, 20.0), ("one", 2025, 1.0), ("gap", 2025, 1.0), ("gap", 2027, 3.0), ("gap", 2028, None)])
    got = {(r["k"], r["year"]): r["value"] for r in annual_series(df, ["k"], 2025, 2030).collect()}
    assert len(got) == 18
    assert got[("a", 2026)] == 12.0 and got[("a", 2025)] == 10.0 and got[("a", 2030)] == 20.0
    assert got[("gap", 2026)] == 2.0 and got[("gap", 2028)] is None and got[("gap", 2030)] is None
    assert all(got[("one", y)] is None for y in range(2025, 2031))


def test_interpolation_refuses_two_rows_for_a_year(spark):
    assert "several rows" in message_of(annual_series(series(spark, [("a", 2025, 1.0), ("a", 2025, 2.0)]), ["k"], 2025, 2026))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 12), st.integers(-100, 100), min_size=2, max_size=13))
def test_interpolation_matches_brute_force(spark, known):
    df = series(spark, [("a", y, float(v)) for y, v in known.items()])
    got = {r["year"]: r["value"] for r in annual_series(df, ["k"], 0, 12).collect()}
    years = sorted(known)
    for y in range(13):
        before, after = [k for k in years if k <= y], [k for k in years if k >= y]
        if not before or not after:
            assert got[y] is None
        else:
            a, b = before[-1], after[0]
            want = known[a] if a == b else known[a] + (known[b] - known[a]) * (y - a) / (b - a)
            assert got[y] == pytest.approx(want)


# ---- inequality -----------------------------------------------------------------------


def deciles(spark, values, group="g"):
    return table(spark, [(group, f"d{i + 1}", float(v)) for i, v in enumerate(values)], "g string, decile string, value double")


def brute_gini(values):
    """Mean absolute difference over twice the mean."""
    n, mean = len(values), sum(values) / len(values)
    return sum(abs(a - b) for a, b in itertools.product(values, values)) / (2 * n * n * mean)


def test_gini_bounds(spark):
    assert one(decile_gini(deciles(spark, [1] * 10), ["g"]).select("gini")) == pytest.approx(0.0)
    assert one(decile_gini(deciles(spark, [0] * 9 + [5]), ["g"]).select("gini")) == pytest.approx(0.9)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 1000), min_size=10, max_size=10))
def test_gini_matches_brute_force(spark, values):
    assert one(decile_gini(deciles(spark, values), ["g"]).select("gini")) == pytest.approx(brute_gini(values))


def test_gini_of_fewer_groups_and_gaps(spark):
    assert one(decile_gini(deciles(spark, [1, 3]), ["g"]).select("gini")) == pytest.approx(brute_gini([1, 3]))
    gap = table(spark, [("g", "d1", 1.0), ("g", "d2", None)], "g string, decile string, value double")
    assert one(decile_gini(gap, ["g"]).select("gini")) is None


def test_gini_refuses_other_categories(spark):
    df = table(spark, [("g", "d1", 1.0), ("g", "x", 1.0)], "g string, decile string, value double")
    assert "outside the decile list" in message_of(decile_gini(df, ["g"]))


def test_shares_sum_to_one(spark):
    got = rows(decile_shares(deciles(spark, range(1, 11)), ["g"]))
    assert len(got) == 10 and all(abs(r[3] - 1) < 1e-12 for r in got)
    assert {r[1]: r[2] for r in got}["d10"] == pytest.approx(10 / 55)


def test_palma(spark):
    assert one(palma(deciles(spark, [1, 1, 1, 1, 5, 5, 5, 5, 5, 8]), ["g"]).select("palma")) == 2.0
    assert one(palma(deciles(spark, [1, 1, 1, 1]), ["g"]).select("palma")) is None
    assert one(palma(deciles(spark, [0, 0, 0, 0, 5, 5, 5, 5, 5, 8]), ["g"]).select("palma")) is None


def test_split_equally_counts_the_categories_in_the_data(spark):
    people = table(spark, [("r", 12.0)], "region string, pop double")
    found = table(spark, [("d1",), ("d1",), ("d2",), ("d3",)], "decile string")
    assert rows(split_equally(people, found, "pop")) == [("r", 4.0, "d1"), ("r", 4.0, "d2"), ("r", 4.0, "d3")]


def test_hot_group_keeps_its_results(spark):
    """A third of the rows in one group: same shares, totals and Gini as counted in Python."""
    rng = random.Random(7)
    data = [("hot" if i % 3 == 0 else f"g{i % 50}", f"d{rng.randint(1, 10)}", float(rng.randint(1, 9))) for i in range(6000)]
    df = table(spark, data, "g string, decile string, value double").repartition(16)
    totals = {}
    for g, _, v in data:
        totals[g] = totals.get(g, 0) + v
    assert all(abs(s - v / totals[g]) < 1e-12 for g, _, v, s in rows(share_of_group(df, ["g"])))
    sums = {}
    for g, d, v in data:
        if g == "hot":
            sums[d] = sums.get(d, 0) + v
    (hot,) = [r["gini"] for r in decile_gini(df, ["g"]).collect() if r["g"] == "hot"]
    assert hot == pytest.approx(brute_gini(list(sums.values())))


# ---- lines and classes ------------------------------------------------------------------


def test_fit_line_per_group(spark):
    df = table(spark, [("a", 1.0, 3.0), ("a", 2.0, 5.0), ("a", 3.0, 7.0), ("a", None, 1.0), ("b", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r for r in fit_line(df, ["g"], "y", "x").collect()}
    assert got["a"]["slope"] == pytest.approx(2) and got["a"]["intercept"] == pytest.approx(1) and got["a"]["n"] == 3
    assert got["b"]["slope"] is None


def test_fixed_class(spark):
    df = table(spark, [(0.5,), (1.0,), (9.0,), (5000.0,), (None,)], "value double")
    assert [r["class"] for r in fixed_class(df, (1, 2, 10)).collect()] == [0, 1, 2, 3, None]


def test_values_on_a_pretty_break_are_in_the_class_above(spark):
    df = table(spark, [(0.0,), (0.3,), (0.5,), (0.6,), (float("nan"),)], "value double")
    got = [(r["class_from"], r["class_to"]) for r in pretty_class(df).collect()]
    assert got == [(0.0, 0.1), (0.3, 0.4), (0.5, 0.6), (0.6, 0.7), (None, None)]


def test_missing_values_have_no_class(spark):
    df = table(spark, [(float("nan"),), (None,)], "value double")
    assert [r["class"] for r in fixed_class(df, (1, 2)).collect()] == [None, None]
    assert [r["class"] for r in kmeans_class(df).collect()] == [None, None]


@pytest.mark.parametrize("cells", ["summed", "single"])
def test_two_runs_of_one_name_fail(spark, cells):
    runs = [("RegGHGPol_Ineq", 10.0), ("RegGHGPol_Gini25_Ineq", 11.0), ("Ref_SSP2_Gini25_Ineq", 100.0), ("RegGHGPol_Gini50_Ineq", 9.0)]
    df = table(spark, [(s, 2020, "a", v) for s, v in runs], "scenario string, year int, sector string, value double")
    assert "DuplicateCell" in message_of(compare(df, ["year", "sector"], POLICY, cells=cells))
    assert "DuplicateCell" in message_of(net_and_relative(df, ["year"], ["sector"], POLICY))
    merged = {r["scenario"]: r["value"] for r in compare(df, ["year", "sector"], POLICY, cells="merged").collect()}
    assert merged == {"Gini25": 101.0, "Gini50": -1.0}


@pytest.mark.parametrize("cells", ["summed", "merged", "single"])
def test_a_scenario_of_no_row_fails_by_name(spark, cells):
    df = table(spark, [("RegGHGPol_Ineq", 2020, 10.0), ("RegGHGPol_Gini25_Ineq", 2020, 11.0)], "scenario string, year int, value double")
    message = message_of(compare(df, ["year"], POLICY, cells=cells))
    assert "AbsentScenario" in message and "Gini50" in message


@pytest.mark.parametrize("low, high, step", [(0, 10, 2), (0, 1, 0.2), (0, 23, 5), (-3, 4, 1), (0, 700, 100), (5, 5, 1)])
def test_pretty_steps(spark, low, high, step):
    df = table(spark, [(float(low),), (float(high),), (None,)], "value double")
    got = pretty_class(df).collect()
    assert got[2]["class_from"] is None
    for r, v in zip(got, (low, high)):
        assert r["class_from"] == pytest.approx(math.floor(v / step) * step)
        assert r["class_to"] - r["class_from"] == pytest.approx(step)


def test_kmeans_classes_against_brute_force(spark):
    values = [1.0, 1.2, 0.9, 20.0, 20.5, 19.8, 50.0, 51.0, 49.0]
    df = table(spark, [(v,) for v in [*values, None]], "value double")
    got = {r["value"]: r["class"] for r in kmeans_class(df, 3).collect()}

    def spread_of(groups):
        return sum(sum((x - sum(g) / len(g)) ** 2 for x in g) for g in groups)

    ordered = sorted(values)
    best = min(
        ([ordered[:i], ordered[i:j], ordered[j:]] for i in range(1, 8) for j in range(i + 1, 9)), key=spread_of)
    assert {v: c + 1 for c, g in enumerate(best) for v in g} == {v: c for v, c in got.items() if v is not None}
    assert got[None] is None


def test_kmeans_ends_at_a_fixed_point_whatever_the_order(spark):
    values = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.3, 5.8, 9.7, 9.3, 40.0]
    first, second = (
        {r["value"]: r["class"] for r in kmeans_class(table(spark, [(v,) for v in data], "value double"), 4).collect()}
        for data in (values, values[::-1]))
    assert first == second
    groups = {c: [v for v in values if first[v] == c] for c in set(first.values())}
    means = {c: sum(g) / len(g) for c, g in groups.items()}
    assert all(abs(v - means[first[v]]) <= abs(v - m) for v in values for m in means.values())


def test_deciles_are_a_closed_list():
    assert DECILES == tuple(f"d{i}" for i in range(1, 11))
