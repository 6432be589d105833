"""Whole results on small hand-computed inputs."""

import pytest
from pyspark.sql import functions as F

from scenlens import scenarios as S
from scenlens.operators import inline_table
from scenlens.plans import compliance, demand, emissions, energy, food, gini_inputs, nutrition, policy_cost, prices, sensitivity
from scenlens.sources import Project, gwp, market_regions, region_map
from tests.helpers import message_of, one, rows, table

B, G25, G50 = "RegGHGPol_Ineq", "RegGHGPol_Gini25_Ineq", "RegGHGPol_Gini50_Ineq"


def project(spark, **tables):
    names = {
        "buildings": energy.BUILDINGS, "industry": energy.INDUSTRY, "transport": energy.TRANSPORT,
        "population": energy.POPULATION, "income": energy.INCOME_QUERY, "primary": energy.PRIMARY, "land": energy.LAND,
        "demand": food.FOOD_DEMAND, "types": food.FOOD_TYPES, "service": demand.SERVICE, "prices": prices.PRICES,
        "non_co2": emissions.NON_CO2, "co2": emissions.CO2_REGION, "co2_sector": emissions.CO2_SECTOR,
        "luc": emissions.LAND_USE, "gdp": policy_cost.GDP, "cost": policy_cost.COST, "und": policy_cost.UNDISCOUNTED,
    }
    return Project({names[k]: (lambda d=d: d) for k, d in tables.items()})


def long(spark, data, *extra):
    columns = ", ".join(["scenario string", "region string", "year int", *[f"`{c}` string" for c in extra], "value double", "Units string"])
    return table(spark, [(*r, "EJ") for r in data], columns)


@pytest.fixture(scope="module")
def energy_project(spark):
    buildings, industry, transport = [], [], []
    for s, f in ((B, 1.0), (G25, 1.5), (G50, 0.5)):
        for region in ("USA", "Canada"):
            for year in (2015, 2020, 2050, 2055):
                buildings.append((s, region, year, "comm heating", 10 * f))
                for d in (1, 2):
                    buildings.append((s, region, year, f"resid heating modern_d{d}", d * f))
                industry.append((s, region, year, 20 * f))
                transport.append((s, region, year, "trn_pass_road_d1", 2 * f))
                transport.append((s, region, year, "trn_aviation_intl", 1 * f))
    people = [(s, r, y, 5.0) for s in (B, G25, G50) for r in ("USA", "Canada") for y in (2015, 2020, 2050, 2055)]
    income = [(s, r, y, f"resid_d{d}", d * (y - 2010.0)) for s in (B, G25, G50) for r in ("USA", "Canada") for y in (2020, 2050) for d in (1, 2)]
    return project(
        spark, buildings=long(spark, buildings, "sector"), industry=long(spark, industry), transport=long(spark, transport, "sector"),
        population=long(spark, people), income=long(spark, income, "consumer"))


def test_final_energy_change(energy_project):
    got = {(r["sector"], r["year"], r["scenario"]): r["value"] for r in energy.final_energy_change(energy_project).collect()}
    assert {y for _, y, _ in got} == {2020, 2050}
    assert got[("Commercial Buildings", 2050, "Gini25")] == 10.0
    assert got[("Residential heating", 2050, "Gini50")] == -3.0
    assert got[("Industry", 2020, "Gini25")] == 20.0
    assert got[("International Aviation (pass)", 2020, "Gini50")] == -1.0
    assert len(got) == 5 * 2 * 2


def test_difference_plus_baseline_is_the_scenario(energy_project):
    levels = {(r["scenario"], r["sector"], r["year"]): r["value"] for r in energy.final_energy_levels(energy_project).collect()}
    for r in energy.final_energy_change(energy_project).where("year = 2050").collect():
        assert levels[("Baseline", r["sector"], 2050)] + r["value"] == levels[(r["scenario"], r["sector"], 2050)]


def test_labels_and_totals(energy_project):
    got = {(r["year"], r["scenario"]): tuple(r)[2:] for r in energy.final_energy_labelled(energy_project).collect()}
    assert got[(2050, "Gini25")] == (36.0, 50.0, "50 %") and got[(2020, "Gini50")] == (-36.0, -50.0, "-50 %")
    assert {r["label"] for r in energy.final_energy_relative(energy_project).collect()} == {"50 %", "-50 %"}


def test_decile_energy_per_person(spark, energy_project):
    rows_ = energy.energy_per_person(energy_project, region_map(spark)).where("year = 2050").collect()
    got = {(r["scenario"], r["region"], r["decile"]): r["value_pc"] for r in rows_}
    assert got[("Baseline", "USA", "d1")] == (1 + 2) * 1e9 / 500
    assert got[("Baseline", "USA", None)] == 1 * 1e9 / 500
    whole = energy.decile_energy_change(energy_project, region_map(spark)).where("year = 2050 AND region = 'USA'").collect()
    change = {(r["scenario"], r["sector"], r["decile"]): r["value_pc"] for r in whole}
    assert change[("Gini25", "Resid heating", "d2")] == 1.0 * 1e9 / 5000
    assert ("Gini25", "Int. Aviation (pass)", None) in change


def test_unknown_region_fails(spark, energy_project):
    few = inline_table(spark, [("USA", "USA")], "region string, region_agg string")
    assert "no match" in message_of(energy.decile_energy_change(energy_project, few))


def test_poorest_growth(energy_project):
    got = {(r["scenario"], r["region"], r["sector"]): (r["change"], r["gdp_pc_change"]) for r in energy.poorest_energy_growth(energy_project).collect()}
    assert got[("Baseline", "USA", "Residential heating")] == (1.0, 4.0)


def test_population_split(energy_project):
    got = rows(energy.population_by_decile(energy_project).where("year = 2020 AND region = 'USA' AND scenario = 'Baseline'").select("decile", "pop"))
    assert got == [("d1", 2500.0), ("d2", 2500.0)]


def test_clean_fuels_keep_rows_without_a_fuel_name(spark):
    data = [(s, "USA", 2050, f, v) for s in (B, G25, G50) for f, v in (("e nuclear", 1.0), ("a oil", 5.0), (None, 2.0))]
    prj = Project({energy.PRIMARY: lambda: long(spark, [(B, "USA", 2050, "a oil CCS", 1.0)], "fuel"),
                   energy.PRIMARY_AVERAGE: lambda: long(spark, data, "fuel")})
    assert set(rows(energy.clean_energy_change(prj).select("fuel", "diff_Gini25"))) == {("e nuclear", 0.0), (None, 0.0), ("a oil CCS", None)}


def test_food_groups_later_rules_win(spark):
    data = [(s, "USA", 2050, "X", "X", "Plant_OilCrop", 1.0, "Pcal") for s in (B, G25, G50)]
    types = table(spark, data, "scenario string, region string, year int, technology string, subsector_3 string, subsector_4 string, value double, Units string")
    assert rows(food.food_subsector_change(project(spark, types=types)).select("subsector").distinct()) == [("Other crops",)]


def test_food_patch(spark):
    data = [(s, "Central Asia", y, "FoodDemand_Group1", "FoodDemand_NonStaples", v) for s, v in ((B, 1.0), (G25, 2.0), (G50, 3.0)) for y in (2045, 2050)]
    prj = project(spark, demand=long(spark, data, "consumer", "input"))
    got = {(r["sce"], r["year"]): r["value"] for r in food.food_map(prj).collect()}
    assert got == {("Gini25", 2045): 1.0, ("Gini50", 2045): 2.0, ("Gini25", 2050): 0.0, ("Gini50", 2050): 0.0}


def test_demand_gini_and_palma(spark):
    rich = [(B, "USA", 2050, f"resid heating modern_d{d}", 8.0 if d == 10 else 1.0) for d in range(1, 11)]
    flat = [(G25, "USA", 2050, f"resid heating modern_d{d}", 2.0) for d in range(1, 11)]
    other = [("Ref", "USA", 2050, "resid heating modern_d1", 9.0)]
    prj = project(
        spark, buildings=long(spark, rich + flat + other, "sector"),
        service=long(spark, [], "sector"), demand=long(spark, [], "consumer", "input"))
    assert set(rows(demand.household_palma(prj).select("scenario", "palma"))) == {("Baseline", 2.0), ("Gini25", 0.25)}
    got = {r["scenario"]: r["value"] for r in demand.demand_gini(prj).collect()}
    shares = [1 / 17] * 9 + [8 / 17]
    want = 1 - sum(s * (1 + 2 * (9 - i)) for i, s in enumerate(shares)) / 10
    assert got["Baseline"] == pytest.approx(want) and got["Gini25"] == pytest.approx(0)
    ratio = one(demand.demand_inequality_ratio(prj).select("ratio_Gini25", "ratio_Gini50"))
    assert ratio == (0.125, None)


def test_price_table(spark):
    data = [(s, m, 2050, v) for s, v in ((B, 15.0), (G25, 15.18), (G50, 24.36)) for m in ("CACCO2", "Middle_EastCO2")]
    data += [(B, "CACCO2_LUC", 2050, 9.0), (B, "xCO2FUG", 2050, 9.0), (G25, "newCO2", 2050, 7.0)]
    raw = table(spark, [(s, m, y, v, "1990$") for s, m, y, v in data], "scenario string, market string, year int, value double, Units string")
    index = table(spark, [(1990, 50.0), (2015, 50.0)], "year int, index double")
    priced = prices.carbon_prices(project(spark, prices=raw), index, market_regions(spark))
    got = {r["region"]: tuple(r)[1:] for r in prices.price_table(priced).collect()}
    assert got["Central America and Caribbean"] == (15.0, 15.0, 24.0, "1.2%", "62.4%")
    assert set(got) == {"Central America and Caribbean", "Middle East", "new"}
    assert got["new"] == (None, 7.0, None, None, None)
    change = {(r["region"], r["scenario"]): r["diff"] for r in prices.price_change(priced).collect()}
    assert change[("new", "Gini25")] == 0.0


def test_gas_without_potential_keeps_the_group(spark):
    gas = table(spark, [(B, "USA", 2020, "SO2", 5.0, "Tg"), (B, "USA", 2025, "CH4", 2.0, "Tg"), (B, "USA", 2025, "SO2", 1.0, "Tg"), (B, "USA", 2025, "CH4", None, "Tg")],
                "scenario string, region string, year int, ghg string, value double, Units string")
    nothing = long(spark, [])
    prj = project(spark, non_co2=gas, co2=nothing, luc=nothing)
    assert set(rows(emissions.regional_ghg(prj, gwp(spark)).select("scenario", "year", "value"))) == {("Base", 2020, 0.0), ("Base", 2025, 56.0)}
    groups = set(rows(emissions.regional_ghg_by_group(prj, gwp(spark)).select("group", "year", "value")))
    assert groups == {("F-gases", 2020, 0.0), ("CH4", 2025, 56.0), ("F-gases", 2025, 0.0)}


def test_land_use_counts_only_in_energy_years(spark):
    prj = project(
        spark, co2_sector=long(spark, [(B, "USA", 2020, 3.0)]), luc=long(spark, [(B, "USA", 2020, 3.0), (B, "USA", 2021, 3.0)]),
        non_co2=table(spark, [], "scenario string, region string, year int, ghg string, value double, Units string"))
    got = rows(emissions.world_ghg(prj, gwp(spark)).select("scenario", "year", F.round("value", 6)))
    assert got == [("Baseline", 2020, 0.022)]


def test_policy_cost(spark):
    gdp = table(spark, [(s, r, y, "GDP", v, "M") for s in (B, G25, G50) for r in ("USA", "Africa_Eastern") for y, v in ((2020, 1.0), (2025, 100.0), (2050, 350.0))],
                "scenario string, region string, year int, account string, value double, Units string")
    cost = long(spark, [(B, "USA", 2050, 10.0), (G25, "USA", 2050, 17.0), (G50, "USA", 2050, 5.0)])
    und = table(spark, [(s, r, y, v) for s, v in ((B, 585.0), (G25, 1170.0), (G50, 0.0)) for r in ("USA", "Africa_Eastern") for y in (2020, 2050)],
                "scenario string, undiscountedcost_3 string, year int, undiscountedcost_4 double")
    prj = project(spark, gdp=gdp, cost=cost, und=und)
    assert set(rows(policy_cost.cumulative_gdp(prj).select("region", "undisc_gdp").distinct())) == {("USA", 5850.0), ("Africa_Eastern", 5850.0)}
    assert set(rows(policy_cost.cost_change(prj).select("scenario", "PolCost", "PolCost_gdp"))) == {("Gini25", 7.0, 2.0), ("Gini50", 0.0, 0.0)}
    got = {(r["region"], r["scenario"]): r["PolCost_chg_gdp"] for r in policy_cost.undiscounted_cost_change(prj).collect()}
    assert got == {("USA", "Gini25"): 10.0, ("USA", "Gini50"): 0.01, ("Africa_Eastern", "Gini25"): 0.01, ("Africa_Eastern", "Gini50"): 0.01}
    world = {r["scenario"]: r["PolCost_chg_gdp"] for r in policy_cost.undiscounted_world_cost_change(prj).collect()}
    assert world == {"Gini25": 10.0, "Gini50": -10.0}


def sheets(spark, values, target):
    schema = "scenario string, region string, ghg string, unit string, `2020` double"
    empty = table(spark, [], schema)
    wide = table(spark, [(s, r, "CH4", "Mt", v / 28) for s, r, v in values], schema)
    return compliance.Sheets(empty, empty, wide, table(spark, target, "region string, year int, value string"))


def test_compliance_rounds_before_the_test(spark):
    book = sheets(
        spark,
        [(B, "a", 103.0), (B, "b", 102.4), (B, "c", 101.0), (B, "d", 5.0), (B, "European Free Trade Association", 900.0), (B, "e", 50.0), (B, "f", 9.0)],
        [("a", 2020, "100"), ("b", 2020, "100"), ("c", 2020, "100"), ("d", 2020, "0"), ("European Free Trade Association", 2020, "1"), ("e", 2020, "100")])
    got = rows(compliance.violations(book, gwp(spark)).select("region", "scenario", "diff_target_sce", "diff_target_sce_perc"))
    assert got == [("a", "PCA", -3.0, -0.03)]
    exact = rows(compliance.violations(book, gwp(spark), round_before_test=False).select("region"))
    assert exact == [("a",), ("b",)]
    assert {r["region"]: r["ghg_target"] for r in compliance.totals_and_target(book, gwp(spark)).collect()}["f"] is None


def demography(spark, data):
    return table(spark, [("m", "SSP2_v9_130115", "r", iso, v, "million", x) for iso, v, x in data] + [("m", "other", "r", "aaa", "Population", "million", 9.0)],
                 "model string, scenario string, region string, iso string, variable string, unit string, X2020 double")


def test_adequacy(spark):
    codes = table(spark, [("aaa", "A", 1), ("bbb", "B", 1), ("ccc", "C", 8)], "iso string, country_name string, region_id int")
    wide = demography(spark, [
        ("aaa", "Population", 4.0), ("aaa", "m", 1.0), ("aaa", "f", 3.0), ("aaa", "Population|Male", 1.0),
        ("bbb", "Population", 1.0), ("bbb", "m", 0.5), ("bbb", "f", 0.5)])
    shares = nutrition.demographic_shares(nutrition.demographic_population(codes, wide))
    countries = nutrition.region_of_country(region_map(spark), codes)
    needs = table(spark, [("m", "u", 3000.0, 0.0, 2000.0, 4000.0), ("f", "u", 2000.0, 0.0, 1000.0, 3000.0)],
                  "variable string, mder_units string, mder double, std double, min double, max double")
    prj = project(
        spark, population=long(spark, [(B, "USA", 2020, 2.0)]), income=long(spark, [(B, "USA", 2020, f"resid_d{d}", 1.0) for d in (1, 2)], "consumer"),
        demand=long(spark, [(B, "USA", 2020, f"FoodDemand_Group{d}", "FoodDemand_Staples", d * 1e-6) for d in (1, 2)], "consumer", "input"))
    got = {r["decile"]: r for r in nutrition.adequacy(prj, region_map(spark), shares, countries, needs).where("scenario IS NOT NULL").collect()}
    male, female = (1 + 0.5) / 5, (3 + 0.5) / 5
    for d in (1, 2):
        eaten = d * 1e-6 * 1e12 / 1000 / 365
        assert got[f"d{d}"]["adesa"] == pytest.approx(eaten / (3000 * male + 2000 * female) * 100)
        assert got[f"d{d}"]["min_adesa"] == pytest.approx(eaten / (2000 * male + 1000 * female) * 100)


def decile_files(spark, extra=()):
    schema = "region_id int, year int, model string, sce string, category string, shares double, gini double"
    pca = "PCA algorithm (Two Components)"
    base = [(i, y, pca, s, c, 0.1, 0.4 if y == 2015 else 0.35) for i in (1, 8) for y in (2015, 2050) for s in ("SSP1", "SSP2") for c in ("d1", "d2")]

    def variant(name, g):
        return table(spark, [(i, 2050, name, "SSP2", c, 0.1, g) for i in (1, 8) for c in ("d1", "d2")], schema)

    start = [(i, 2015, name, "SSP2", "d1", 0.1, 0.4) for i in (1, 8) for name in ("Gini25", "Gini50")]
    return gini_inputs.DecileFiles(
        table(spark, base + list(extra), schema),
        (variant("Gini25", 0.3).union(table(spark, [r for r in start if r[2] == "Gini25"], schema)),
         variant("Gini50", 0.2).union(table(spark, [r for r in start if r[2] == "Gini50"], schema))))


def test_gini_changes(spark):
    files, regions = decile_files(spark), region_map(spark)
    assert rows(gini_inputs.gini_table(files, regions)) == [("Canada", -0.05, -0.1, -0.2), ("USA", -0.05, -0.1, -0.2)]
    got = {(r["ssp"], r["subRegion"]): r["value"] for r in gini_inputs.pathway_gini_change(files, regions).collect()}
    assert got[("SSP1", "USA")] == -0.05 and got[("Gini50", "Canada")] == -0.2 and got[("SSP5", "USA")] is None


def test_two_ginis_for_one_year_fail(spark):
    other = [(1, 2015, "Lognormal functional form", "SSP2", "d1", 0.1, 0.9)]
    assert "DuplicateCell" in message_of(gini_inputs.gini_table(decile_files(spark, other), region_map(spark)))


def test_lowest_gini_drops_text_that_is_no_number(spark):
    history = table(spark, [("abw", "#N/A"), ("afg", "29.5")], "iso string, GiniMinHist string")
    names = table(spark, [("AFG", "Afghanistan", "Asia")], "iso string, country_name string, continent string")
    assert rows(gini_inputs.lowest_gini(history, names)) == [("AFG", 29.5, "Afghanistan", "Asia")]


def test_sensitivity_fit(spark):
    schema = "region_id int, year int, model string, sce string, category string, shares double, gini double"
    pca = "PCA algorithm (Two Components)"
    deciles = table(spark, [(1, 2050, pca, f"SSP{i}", c, 0.1, i / 10) for i in (1, 2, 3) for c in ("d1", "d2")], schema)
    facts = long(spark, [(f"SA_PCA_SSP{i}", "USA", 2050, 10.0 * i) for i in (1, 2, 3)])
    prj = Project({q: (lambda: facts) for q in (energy.BUILDINGS, energy.INDUSTRY, energy.TRANSPORT_TOTAL)})
    line = sensitivity.energy_gini_fit(prj, deciles, region_map(spark)).collect()[0]
    assert line["region"] == "USA" and line["slope"] == pytest.approx(300) and line["n"] == 3


def test_no_policy_family(spark):
    data = [(s, "USA", 2050, v) for s, v in (("Ref_SSP2_Ineq", 1.0), ("Ref_SSP2_Gini25_Ineq", 3.0), ("Ref_SSP2_Gini50_Ineq", 6.0))]
    prj = project(spark, co2=long(spark, data))
    assert set(rows(emissions.world_co2(prj, S.NO_POLICY).select("scenario", "value"))) == {
        ("Baseline_NoClimPol", 1.0), ("Gini25_NoClimPol", 3.0), ("Gini50_NoClimPol", 6.0)}
    assert set(rows(emissions.regional_co2_change(prj).select("scenario", "value"))) == {("Gini25", 2.0), ("Gini50", 5.0)}


def test_no_raw_rows_are_shuffled_to_a_few_years(spark):
    """With broadcasts off, as by estimate on large tables: what meets the years of the other table has been summed."""
    data = [(B, "USA", y, 1.0) for y in (2020, 2030)]
    prj = project(spark, luc=long(spark, data), co2_sector=long(spark, data), non_co2=long(spark, [(B, "USA", 2020, "CH4", 1.0)], "ghg"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = emissions.world_ghg(prj, gwp(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(year#" in line]
    assert dealt and all("HashAggregate" in "".join(lines[i + 1 : i + 3]) for i in dealt)


def test_exchanges_of_the_need_per_person(spark):
    """The population is read once: no join with itself for the totals, one chain of sums."""
    demography = table(spark, [("M", nutrition.DEMOGRAPHIC_RUN, "x", "usa", v, "million", 1.0, 2.0) for v in ("Population", "Population|Male|Aged0-4")],
                       "model string, scenario string, region string, iso string, variable string, unit string, `2020` double, `2050` double")
    codes = table(spark, [("usa", "United States", "x", 1)], "iso string, country_name string, legacy_region string, region_id int")
    needs = table(spark, [("Population|Male|Aged0-4", 1.0, 1.0, 1.0)], "variable string, mder double, min double, max double")
    shares = nutrition.demographic_shares(nutrition.demographic_population(codes, demography))
    need = nutrition.need_per_person(shares, nutrition.region_of_country(region_map(spark), codes), needs)
    assert need._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 10


def test_intake_and_people_checks_units_and_persons(spark):
    people = long(spark, [(B, "USA", 2030, "x", 20.0)], "label")
    deciles = long(spark, [(B, "USA", 2030, "resid_d1", 1.0), (B, "USA", 2030, "resid_d2", 1.0)], "consumer")
    def prj(*eaten):
        facts = table(spark, [(B, "USA", y, "FoodDemand_Group1", "FoodDemand_Staples", u, v) for y, u, v in eaten],
                      "scenario string, region string, year int, consumer string, input string, Units string, value double")
        return Project({energy.POPULATION: lambda: people, energy.INCOME_QUERY: lambda: deciles, food.FOOD_DEMAND: lambda: facts})
    got = rows(food.intake_and_people(prj((2030, "Pcal", 1.0), (2030, "Pcal", 2.0)), region_map(spark)).select("decile", "pop", "value"))
    assert got == [("d1", 10_000.0, 3e12 / 10_000 / 365), ("d2", 10_000.0, None)]
    assert "without persons" in message_of(food.intake_and_people(prj((2040, "Pcal", 1.0)), region_map(spark)))
    assert "several units" in message_of(food.intake_and_people(prj((2030, "Pcal", 1.0), (2030, "t", 1.0)), region_map(spark)))
