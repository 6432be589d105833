"""Nutrition, inequality, price, emission, cost and input results with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenlens.constants import GWP
from scenlens.operators import kmeans_class
from scenlens.plans import compliance as CO
from scenlens.plans import demand as DM
from scenlens.plans import emissions as EM
from scenlens.plans import energy as E
from scenlens.plans import food as D
from scenlens.plans import gini_inputs as G
from scenlens.plans import nutrition as N
from scenlens.plans import policy_cost as PC
from scenlens.plans import prices as P
from scenlens.plans import sensitivity as SA
from scenlens.sinks import write_report
from scenlens.sources import gwp, market_regions, region_map
from testbed.entry import (
    WINDOW, Entry, canon, display, fresh, kmeans, long, number_text, pretty, region_rows, side, strict, study, wide,
)
from testbed.results_energy import POPAGG, ROWS, roll
from testbed.tables import DUCK, side_sql

# ---- nutrition -------------------------------------------------------------


def countries(t):
    return N.region_of_country(region_map(t.spark), t.side("codes"))


def shares(t):
    return N.demographic_shares(N.demographic_population(t.side("codes"), t.side("demography")))


def people(t):
    return D.population_decile_aggregate(t.project(), region_map(t.spark))


KEY = {"ckey": f"SELECT DISTINCT country_name, r.region_id, region_agg AS region FROM {region_rows()} r LEFT JOIN codes USING (region_id)"}
DEMO = {
    **KEY,
    "dlong": """SELECT c.iso, c.country_name, scenario, variable, 'total population' AS unit,
        CAST(substr(y, 2) AS INT) AS year, v * 1e6 AS value
        FROM codes c LEFT JOIN (UNPIVOT demography ON COLUMNS('^X[0-9]+$') INTO NAME y VALUE v) d ON d.iso = c.iso""",
    "dshare": """SELECT l.iso, country_name, scenario, variable, unit AS pop_units, l.year, value AS sub_pop, total_pop,
        value / nullif(total_pop, 0) AS demo_share
        FROM dlong l LEFT JOIN (SELECT iso, year, value AS total_pop FROM dlong WHERE variable = 'Population') t
        ON t.iso = l.iso AND t.year = l.year
        WHERE variable IS NOT NULL AND variable NOT IN ('Population', 'Population|Male', 'Population|Female')""",
    "dregion": f"""SELECT *, sum(total_pop) OVER (PARTITION BY year, region) AS total_regional_pop FROM (
        SELECT DISTINCT year, country_name, region, total_pop FROM dshare LEFT JOIN ckey USING (country_name)) AS x""",
    "dweight": """SELECT DISTINCT s.year, s.country_name, s.variable, k.region, demo_share,
        s.total_pop / nullif(total_regional_pop, 0) AS weight
        FROM dshare s JOIN dregion k ON k.country_name = s.country_name AND k.year = s.year""",
}
SIDES = ("codes", "demography", "needs")
PEOPLE = {"people": E.POPULATION, "inc": E.INCOME_QUERY, "fd": D.FOOD_DEMAND}


def nutrition(body, **ctes):
    extra = {n: side_sql(n, DUCK) for n in SIDES}
    return study(PEOPLE, body, **extra, **DEMO, **ROWS, **POPAGG, **ctes)


SEXAGE = {
    "sexage": """SELECT p.scenario, variable, w.year, w.region, p.decile, sum(demo_share * weight * pop) AS pop_sex_age
        FROM dweight w LEFT JOIN pd p ON p.region = w.region AND p.year = w.year
        GROUP BY p.scenario, variable, w.year, w.region, p.decile""",
}
NEED = {
    "need": f"""SELECT scenario, {display()} AS region, year, decile, sum(mder * pop_sex_age) AS denominator_sum,
        sum("min" * pop_sex_age) AS min_denominator_sum, sum("max" * pop_sex_age) AS max_denominator_sum
        FROM sexage LEFT JOIN needs USING (variable) WHERE {WINDOW} GROUP BY ALL""",
}
EATEN = {
    "fr": roll("rows", "scenario, region, decile, year, Units"),
    "eaten": f"""SELECT r.scenario, {display('r.region')} AS region, r.decile, r.year,
        value * 1e12 / nullif(pop, 0) / 365 AS value, pop FROM fr r JOIN pd USING (year, region, decile, scenario)""",
}


def needs_file(t):
    """The needs written as a file and read back by the plan."""
    path = fresh(t, "needs")
    write_report(t.side("needs"), path)
    return N.calorie_needs(t.spark, path)


OTHER: dict[str, Entry] = {
    "n46_calorie_needs": Entry(
        lambda t: needs_file(t),
        side(["needs"], "SELECT * REPLACE ('kcal/capita/day' AS mder_units) FROM needs")),
    "n47_region_of_country": Entry(lambda t: countries(t), side(["codes"], "SELECT * FROM ckey", **KEY)),
    "n48_demographic_population": Entry(
        lambda t: N.demographic_population(t.side("codes"), t.side("demography")),
        side(["codes", "demography"], "SELECT * FROM dlong", **DEMO)),
    "n49_demographic_shares": Entry(
        lambda t: shares(t), side(["codes", "demography"], "SELECT * FROM dshare", **DEMO)),
    "n50_regional_population": Entry(
        lambda t: N.regional_population(shares(t), countries(t)),
        side(["codes", "demography"], "SELECT * FROM dregion", **DEMO)),
    "n51_population_by_sex_age": Entry(
        lambda t: N.population_by_sex_age(shares(t), countries(t), people(t)),
        nutrition("SELECT * FROM sexage", **SEXAGE), {"pop_sex_age": 4}),
    "n52_calorie_requirement": Entry(
        lambda t: N.calorie_requirement(shares(t), countries(t), t.side("needs"), people(t)),
        nutrition("SELECT * FROM need", **SEXAGE, **NEED),
        {"denominator_sum": 4, "min_denominator_sum": 4, "max_denominator_sum": 4}),
    "n54_adequacy": Entry(
        lambda t: N.adequacy(t.project(), region_map(t.spark), shares(t), countries(t), t.side("needs")),
        nutrition("""SELECT year, region, scenario, decile, value / nullif(denominator_sum, 0) * pop * 100 AS adesa,
            value / nullif(min_denominator_sum, 0) * pop * 100 AS min_adesa,
            value / nullif(max_denominator_sum, 0) * pop * 100 AS max_adesa
            FROM need LEFT JOIN eaten USING (scenario, region, year, decile)""", **SEXAGE, **NEED, **EATEN),
        {"adesa": 2, "min_adesa": 2, "max_adesa": 2}),
}

# ---- demand inequality -------------------------------------------------------

INEQ = {"bld": E.BUILDINGS, "srv": DM.SERVICE, "fd": D.FOOD_DEMAND}
EXACT = """CASE WHEN contains(scenario, 'Gini25') THEN 'Gini25' WHEN contains(scenario, 'Gini50') THEN 'Gini50'
    WHEN scenario = 'RegGHGPol_Ineq' THEN 'Baseline' ELSE scenario END"""
INEQCTE = {
    "hh": f"""SELECT {EXACT} AS scenario, region, year, value, split_part(sector, '_', 2) AS decile,
        CASE WHEN contains(sector, 'cooling') THEN 'Resid cooling' WHEN contains(sector, 'heating') THEN 'Resid heating'
        WHEN contains(sector, 'others') THEN 'Resid non-thermal' END AS sector FROM bld WHERE contains(sector, 'modern')""",
    "tr": f"""SELECT {EXACT} AS scenario, region, year, value, regexp_extract(sector, '_(d[0-9]+)$', 1) AS decile,
        CASE WHEN contains(sector, 'aviation') THEN 'International aviation' ELSE 'Domestic transportation' END AS sector
        FROM srv WHERE contains(sector, 'trn_pass_d') OR contains(sector, 'aviat')""",
    "fo": f"""SELECT {EXACT} AS scenario, region, year, value, replace(split_part(consumer, '_', 2), 'Group', 'd') AS decile,
        'Non-staple food' AS sector FROM fd WHERE contains(input, 'NonStaples')""",
    "alld": "SELECT * FROM hh UNION ALL BY NAME SELECT * FROM tr UNION ALL BY NAME SELECT * FROM fo",
    "dec": f"SELECT scenario, region, sector, decile, year, {strict('value')} AS value FROM alld GROUP BY ALL",
}


def palma_sql(src):
    cell = lambda d: f"max(value) FILTER (WHERE decile = '{d}')"
    return f"""SELECT scenario, region, sector, year,
        {cell('d10')} / nullif({cell('d1')} + {cell('d2')} + {cell('d3')} + {cell('d4')}, 0) AS palma
        FROM (SELECT scenario, region, sector, decile, year, {strict('value')} AS value FROM {src} GROUP BY ALL) AS x
        GROUP BY scenario, region, sector, year"""


LEVELS = """CASE scenario WHEN 'Baseline' THEN 1 WHEN 'Gini25' THEN 2 WHEN 'Gini50' THEN 3 END AS scenario_level,
    CASE class WHEN 'Resid cooling' THEN 1 WHEN 'Resid heating' THEN 2 WHEN 'Resid non-thermal' THEN 3
    WHEN 'Domestic transportation' THEN 4 WHEN 'International aviation' THEN 5 WHEN 'Non-staple food' THEN 6 END AS class_level"""
PALMAP = {
    "pm": f"""SELECT scenario, region AS "subRegion", sector AS class, year, palma AS value
        FROM ({palma_sql('alld')}) AS x WHERE year IN (2030, 2050)""",
}
GINI = {
    "sh": """SELECT *, value / nullif(sum(value) OVER (PARTITION BY scenario, region, sector, year), 0) AS share FROM dec""",
    "rk": """SELECT *, row_number() OVER (PARTITION BY scenario, region, sector, year ORDER BY share) AS i,
        count(*) OVER (PARTITION BY scenario, region, sector, year) AS n FROM sh""",
    "gi": """SELECT scenario, region AS "subRegion", sector AS class, year, 1 - sum(share * (1 + 2 * (n - i))) / any_value(n) AS value
        FROM rk WHERE year IN (2030, 2050) GROUP BY scenario, region, sector, year""",
}

OTHER |= {
    "n55_household_palma": Entry(lambda t: DM.household_palma(t.project()), study(INEQ, palma_sql("hh"), **INEQCTE)),
    "n56_transport_palma": Entry(lambda t: DM.transport_palma(t.project()), study(INEQ, palma_sql("tr"), **INEQCTE)),
    "n57_food_palma": Entry(lambda t: DM.food_palma(t.project()), study(INEQ, palma_sql("fo"), **INEQCTE)),
    "n58_demand_inequality": Entry(
        lambda t: DM.demand_inequality(t.project()),
        study(INEQ, f"SELECT *, {LEVELS} FROM pm", **INEQCTE, **PALMAP)),
    "n58_demand_inequality_classes": Entry(
        lambda t: kmeans_class(DM.demand_inequality(t.project()).withColumnRenamed("class", "demand")),
        study(INEQ, kmeans("km"), **INEQCTE, **PALMAP, km=f"SELECT * RENAME (class AS demand) FROM (SELECT *, {LEVELS} FROM pm) AS l")),
    "n59_demand_inequality_ratio": Entry(
        lambda t: DM.demand_inequality_ratio(t.project()),
        study(INEQ, """SELECT "subRegion", class, year, b AS "Baseline", g25 AS "Gini25", g50 AS "Gini50",
            g25 / nullif(b, 0) AS "ratio_Gini25", g50 / nullif(b, 0) AS "ratio_Gini50" FROM w""",
            **INEQCTE, **PALMAP, w=wide("pm", '"subRegion", class, year'))),
    "n60_demand_by_decile": Entry(lambda t: DM.demand_by_decile(t.project()), study(INEQ, "SELECT * FROM dec", **INEQCTE)),
    "n61_demand_shares": Entry(
        lambda t: DM.demand_shares(t.project()),
        study(INEQ, """SELECT scenario, region, sector, year, decile AS category, share,
            sum(share) OVER (PARTITION BY scenario, region, sector, year) AS share_check FROM sh WHERE year <= 2050""",
            **INEQCTE, **GINI), {"share_check": 8}),
    "n62_demand_gini": Entry(
        lambda t: DM.demand_gini(t.project()), study(INEQ, f"SELECT *, {LEVELS} FROM gi", **INEQCTE, **GINI), {"value": 10}),
    "n62_demand_gini_classes": Entry(
        lambda t: kmeans_class(DM.demand_gini(t.project()).withColumnRenamed("class", "demand")),
        study(INEQ, kmeans("km"), **INEQCTE, **GINI, km=f"SELECT * RENAME (class AS demand) FROM (SELECT *, {LEVELS} FROM gi) AS l"),
        {"value": 10}),
}

# ---- prices ----------------------------------------------------------------

PRICE_ALIAS = """CASE m WHEN 'CAC' THEN 'Central America and Caribbean' WHEN 'Central_Asia' THEN 'Central Asia'
    WHEN 'EFTA' THEN 'European Free Trade Association' WHEN 'EU-12' THEN 'EU_12' WHEN 'EU-15' THEN 'EU_15'
    WHEN 'Middle_East' THEN 'Middle East' WHEN 'SAN' THEN 'South America_Northern'
    WHEN 'SAS' THEN 'South America_Southern' WHEN 'South_Africa' THEN 'South Africa'
    WHEN 'South_Asia' THEN 'South Asia' WHEN 'South_Korea' THEN 'South Korea'
    WHEN 'Southeast_Asia' THEN 'Southeast Asia' ELSE m END"""
PRICECTE = {
    "idx": side_sql("price_index", DUCK),
    "pr": f"""SELECT {EXACT} AS scenario, {PRICE_ALIAS} AS region, year,
        value * ((SELECT "index" FROM idx WHERE year = 2015) / (SELECT "index" FROM idx WHERE year = 1990)) AS value,
        '2015$/tC' AS Units
        FROM (SELECT *, replace(market, 'CO2', '') AS m FROM raw WHERE NOT contains(market, 'FUG')
            AND NOT contains(market, 'LUC') AND year BETWEEN 2015 AND 2050) AS x""",
    "pw": wide("pr", "region, year, Units"),
}
PRICES = {"raw": P.PRICES}


def price_rows(t):
    return P.carbon_prices(t.project(), t.side("price_index"), market_regions(t.spark))


def pct_text(v):
    return f"{number_text(v, 1)} || '%'"


OTHER |= {
    "n63_carbon_prices": Entry(lambda t: price_rows(t), study(PRICES, "SELECT * FROM pr", **PRICECTE)),
    "n64_price_levels": Entry(
        lambda t: P.price_levels(price_rows(t)),
        study(PRICES, """SELECT region, year, round_even(b, 0) AS "Baseline", round_even(g25, 0) AS "Gini25",
            round_even(g50, 0) AS "Gini50", round_even(g25 - b, 1) AS "Diff_Gini25", round_even(g50 - b, 1) AS "Diff_Gini50"
            FROM pw WHERE year IN (2030, 2050)""", **PRICECTE),
        {"Diff_Gini25": 1, "Diff_Gini50": 1}),
    "n65_price_table": Entry(
        lambda t: P.price_table(price_rows(t)),
        study(PRICES, f"""SELECT region, round_even(b, 0) AS "Baseline", round_even(g25, 0) AS "Gini25",
            round_even(g50, 0) AS "Gini50", {pct_text('(g25 - b) / nullif(b, 0) * 100')} AS "%Diff_Gini25",
            {pct_text('(g50 - b) / nullif(b, 0) * 100')} AS "%Diff_Gini50" FROM pw WHERE year = 2050""", **PRICECTE)),
    "n66_price_change": Entry(
        lambda t: P.price_change(price_rows(t)),
        study(PRICES, f"""SELECT region, year, scenario, coalesce(diff, 0) AS diff, '2015$' AS units
            FROM ({long('pw', 'region, year', out='diff')}) AS x""", **PRICECTE)),
    "n66_price_map": Entry(
        lambda t: P.price_map(price_rows(t)),
        study(PRICES, pretty("pmap"), **PRICECTE, pmap=f"""SELECT region AS "subRegion", year, scenario,
            coalesce(diff, 0) AS value, '2015$/tCO2-eq' AS units
            FROM ({long('pw', 'region, year', out='diff')}) AS x WHERE year = 2050""")),
}

# ---- emissions ----------------------------------------------------------------

GWPCTE = {"gw": "SELECT * FROM (VALUES " + ", ".join(f"('{g}', {v!r}e0)" for g, v in GWP) + ") AS t(ghg, gwp)"}
GASES = {"non": EM.NON_CO2, "luc": EM.LAND_USE, "co2s": EM.CO2_SECTOR, "co2r": EM.CO2_REGION}
BASE = canon("RegGHGPol", "Base")
GASCTE = {
    **GWPCTE,
    "world": f"""SELECT scenario, region, year, ghg, value FROM non UNION ALL
        SELECT scenario, region, year, 'CO2LUC', {strict('value')} FROM luc WHERE year IN (SELECT year FROM co2s)
        GROUP BY scenario, region, year UNION ALL
        SELECT scenario, region, year, 'CO2', {strict('value')} FROM co2s GROUP BY scenario, region, year""",
    "regional": """SELECT scenario, region, year, ghg, value FROM non UNION ALL
        SELECT scenario, region, year, 'CO2LUC', value FROM luc UNION ALL
        SELECT scenario, region, year, 'CO2', value FROM co2r""",
    "rg": f"""SELECT {BASE} AS scenario, region, year, 'MtCO2e' AS Units, coalesce(sum(value * gwp), 0) AS value
        FROM regional LEFT JOIN gw USING (ghg) WHERE {WINDOW} GROUP BY 1, region, year""",
}
NP = {"co2r": EM.CO2_REGION}

OTHER |= {
    "n67_world_ghg": Entry(
        lambda t: EM.world_ghg(t.project(), gwp(t.spark)),
        study(GASES, f"""SELECT {canon('RegGHGPol')} AS scenario, year, coalesce(sum(value * gwp), 0) / 1000 AS value,
            'GtCO2e' AS Units FROM world LEFT JOIN gw USING (ghg) WHERE year BETWEEN 2015 AND 2050 GROUP BY 1, year""", **GASCTE),
        {"value": 6}),
    "n72_pollutants": Entry(
        lambda t: EM.pollutants(t.project()),
        study(GASES, f"""SELECT {canon()} AS scenario, g AS ghg, year, Units, {strict('value')} AS value
            FROM (SELECT *, CASE WHEN contains(split_part(ghg, '_', 1), 'HFC') THEN 'HFC' ELSE split_part(ghg, '_', 1) END AS g FROM non) AS x
            WHERE g IN ('BC', 'CH4', 'CO', 'N2O', 'NH3', 'NMVOC', 'NOx', 'OC', 'SO2') AND year BETWEEN 2015 AND 2050
            GROUP BY 1, g, year, Units""")),
    "n73_regional_ghg": Entry(
        lambda t: EM.regional_ghg(t.project(), gwp(t.spark)), study(GASES, "SELECT * FROM rg", **GASCTE), {"value": 4}),
    "n74_regional_ghg_relative": Entry(
        lambda t: EM.regional_ghg_relative(t.project(), gwp(t.spark)),
        study(GASES, """SELECT region, year, Units, b AS "Base", g25 AS "Gini25", g50 AS "Gini50",
            (g25 - b) / nullif(b, 0) AS "diff_Gini25", (g50 - b) / nullif(b, 0) AS "diff_Gini50" FROM w""",
            **GASCTE, w=wide("rg", "region, year, Units", baseline="Base")),
        {"Base": 4, "Gini25": 4, "Gini50": 4, "diff_Gini25": 8, "diff_Gini50": 8}),
    "n75_regional_ghg_by_group": Entry(
        lambda t: EM.regional_ghg_by_group(t.project(), gwp(t.spark)),
        study(GASES, f"""SELECT {BASE} AS scenario, region, CASE WHEN contains(ghg, 'CH4') THEN 'CH4' WHEN ghg = 'CO2' THEN 'CO2'
            WHEN ghg = 'CO2LUC' THEN 'CO2_LUC' WHEN ghg IS NOT NULL THEN 'F-gases' END AS "group", year, 'MtCO2e' AS Units,
            coalesce(sum(value * gwp), 0) AS value FROM regional LEFT JOIN gw USING (ghg) WHERE {WINDOW} GROUP BY 1, region, 3, year""",
            **GASCTE), {"value": 4}),
    "n81_world_co2_no_policy": Entry(
        lambda t: EM.world_co2(t.project("no_policy")),
        study(NP, f"""SELECT {canon('Ref_SSP2')} || '_NoClimPol' AS scenario, year, Units, {strict('value')} AS value
            FROM co2r WHERE {WINDOW} GROUP BY 1, year, Units""", "no_policy")),
    "n81_world_co2_span": Entry(
        lambda t: EM.value_span(EM.world_co2(t.project("no_policy"))),
        study(NP, f"""SELECT min(value) AS lowest, max(value) AS highest FROM (SELECT {strict('value')} AS value
            FROM co2r WHERE {WINDOW} GROUP BY scenario, year, Units) AS x""", "no_policy")),
    "n82_regional_co2_change_no_policy": Entry(
        lambda t: EM.regional_co2_change(t.project("no_policy")),
        study(NP, long("w", "region, year, Units"), "no_policy",
            d=f"SELECT * REPLACE ({canon('Ref_SSP2')} AS scenario) FROM co2r WHERE {WINDOW}", w=wide("d", "region, year, Units"))),
}

# ---- policy cost ----------------------------------------------------------------

COST = {"gdp0": PC.GDP, "cost0": PC.COST, "und0": PC.UNDISCOUNTED}
COSTCTE = {
    "gdp": f"SELECT * REPLACE ({canon()} AS scenario) FROM gdp0",
    "keys": "SELECT DISTINCT scenario, region FROM gdp WHERE year BETWEEN 2025 AND 2050",
    "grid": "SELECT * FROM keys, (SELECT unnest(generate_series(2025, 2050)) AS year) AS y",
    "filled": """SELECT g.scenario, g.region, g.year, v.value,
        last_value(v.value IGNORE NULLS) OVER before AS v0, last_value(CASE WHEN v.value IS NOT NULL THEN g.year END IGNORE NULLS) OVER before AS y0,
        first_value(v.value IGNORE NULLS) OVER after AS v1, first_value(CASE WHEN v.value IS NOT NULL THEN g.year END IGNORE NULLS) OVER after AS y1
        FROM grid g LEFT JOIN gdp v ON v.scenario = g.scenario AND v.region = g.region AND v.year = g.year
        WINDOW before AS (PARTITION BY g.scenario, g.region ORDER BY g.year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        after AS (PARTITION BY g.scenario, g.region ORDER BY g.year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "cum": """SELECT scenario, region, CASE WHEN count(*) = count(p) THEN sum(p) END AS undisc_gdp, 'million 1990$' AS Units
        FROM (SELECT *, CASE WHEN y0 = y1 THEN value ELSE v0 + (v1 - v0) * (year - y0) / (y1 - y0) END AS p FROM filled) AS x
        GROUP BY scenario, region""",
    "cumw": f"SELECT scenario, Units, {strict('undisc_gdp')} AS undisc_gdp FROM cum GROUP BY scenario, Units",
    "und": f"""SELECT DISTINCT {canon()} AS scenario, undiscountedcost_3 AS region, undiscountedcost_4 AS "PolCost" FROM und0""",
    "ur": """SELECT scenario, region, "PolCost" / nullif(undisc_gdp, 0) * 100 AS value FROM und JOIN cum USING (scenario, region)""",
    "uw": wide("ur", "region"),
    "uc": f"""SELECT region, scenario, CASE region WHEN 'Africa_Eastern' THEN 0.01e0 WHEN 'European Free Trade Association' THEN 0e0
        ELSE CASE WHEN v < 0 THEN 0.01e0 ELSE v END END AS "PolCost_chg_gdp" FROM ({long('uw', 'region', out='v')}) AS x""",
}
OTHER |= {
    "n68_cumulative_gdp": Entry(
        lambda t: PC.cumulative_gdp(t.project()), study(COST, "SELECT * FROM cum", **COSTCTE), {"undisc_gdp": 4}),
    "n68_cumulative_world_gdp": Entry(
        lambda t: PC.cumulative_world_gdp(t.project()), study(COST, "SELECT * FROM cumw", **COSTCTE), {"undisc_gdp": 2}),
    "n69_cost_change": Entry(
        lambda t: PC.cost_change(t.project()),
        study(COST, """SELECT l.year, l.region, l.scenario, CASE WHEN v < 0 THEN 0e0 ELSE v END AS "PolCost",
            'Million$1990' AS unit_polcost, g.value, CASE WHEN v < 0 THEN 0e0 ELSE v END / nullif(g.value, 0) * 100 AS "PolCost_gdp"
            FROM l JOIN gdp g ON g.scenario = l.scenario AND g.region = l.region AND g.year = l.year""", **COSTCTE,
            c=f"SELECT * REPLACE ({canon()} AS scenario) FROM cost0 WHERE year = 2050", w=wide("c", "year, region"),
            l=long("w", "year, region", out="v"))),
    "n70_undiscounted_cost_change": Entry(
        lambda t: PC.undiscounted_cost_change(t.project()), study(COST, "SELECT * FROM uc", **COSTCTE), {"PolCost_chg_gdp": 10}),
    "n70_undiscounted_cost_map": Entry(
        lambda t: PC.undiscounted_cost_map(t.project()),
        study(COST, pretty("um"), **COSTCTE,
            um="""SELECT region AS "subRegion", scenario, "PolCost_chg_gdp" AS value, '%' AS units FROM uc"""),
        {"value": 10, "class_from": 8, "class_to": 8}),
    "n71_undiscounted_world_cost_change": Entry(
        lambda t: PC.undiscounted_world_cost_change(t.project()),
        study(COST, f"""SELECT 'Gini25' AS scenario, g25 - b AS "PolCost_chg_gdp" FROM ww UNION ALL SELECT 'Gini50', g50 - b FROM ww""",
            **COSTCTE,
            wr=f"""SELECT scenario, "PolCost" / nullif(undisc_gdp, 0) * 100 AS value
                FROM (SELECT scenario, {strict('"PolCost"')} AS "PolCost" FROM und GROUP BY scenario) AS x JOIN cumw USING (scenario)""",
            ww=wide("wr", "")), {"PolCost_chg_gdp": 10}),
}

# ---- sensitivity ------------------------------------------------------------------

SENS = {"bld": E.BUILDINGS, "ind": E.INDUSTRY, "trn": E.TRANSPORT_TOTAL, "raw": P.PRICES}
SENSCTE = {
    "dec": side_sql("deciles", DUCK), "reg": region_rows(),
    "gr": f"""SELECT DISTINCT dec.region_id, year, CASE model WHEN 'PCA algorithm (Two Components)' THEN 'SA_PCA' ELSE 'SA_LogNorm' END
        || '_' || sce AS scenario, gini, region FROM dec JOIN reg USING (region_id) WHERE {WINDOW}""",
    "gm": f"SELECT scenario, year, avg(gini) AS gini FROM gr GROUP BY scenario, year",
    "te": f"""SELECT scenario, region, year, Units, {strict('value')} AS value FROM (
        SELECT scenario, region, year, Units, value FROM bld UNION ALL SELECT scenario, region, year, Units, value FROM ind
        UNION ALL SELECT scenario, region, year, Units, value FROM trn) AS x WHERE {WINDOW} GROUP BY ALL""",
    "wp": f"SELECT * FROM raw WHERE market = 'globalCO2' AND {WINDOW}",
    "eg": "SELECT gr.*, te.Units, te.value AS tfe FROM gr JOIN te USING (scenario, region, year)",
    "pg": "SELECT scenario, year, gini, wp.value AS cprice FROM gm JOIN wp USING (scenario, year)",
}
FIT = {"slope": 4, "intercept": 4, "r2": 6}


def sens(body):
    return study(SENS, body, "sensitivity", **SENSCTE)


def fit_sql(src, key, y, x, where):
    return f"""SELECT {key}, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2,
        CAST(regr_count({y}, {x}) AS BIGINT) AS n FROM {src} WHERE {where} GROUP BY {key}"""


def sa(t):
    return t.project("sensitivity"), t.side("deciles"), region_map(t.spark)


OTHER |= {
    "n83_regional_gini": Entry(lambda t: SA.regional_gini(t.side("deciles"), region_map(t.spark)), sens("SELECT * FROM gr")),
    "n83_world_gini": Entry(
        lambda t: SA.world_gini(t.side("deciles"), region_map(t.spark)), sens("SELECT * FROM gm"), {"gini": 8}),
    "n84_regional_energy": Entry(lambda t: SA.regional_energy(t.project("sensitivity")), sens("SELECT * FROM te")),
    "n85_world_price": Entry(lambda t: SA.world_price(t.project("sensitivity")), sens("SELECT * FROM wp")),
    "n86_energy_against_gini": Entry(lambda t: SA.energy_against_gini(*sa(t)), sens("SELECT * FROM eg")),
    "n86_energy_gini_fit": Entry(
        lambda t: SA.energy_gini_fit(*sa(t)),
        sens(fit_sql("eg", "region", "tfe", "gini", """year = 2050 AND region IN ('Africa_Eastern', 'Brazil', 'China', 'EU-15',
            'India', 'Japan', 'Russia', 'South Asia', 'USA')""")), FIT),
    "n87_price_against_gini": Entry(lambda t: SA.price_against_gini(*sa(t)), sens("SELECT * FROM pg"), {"gini": 8}),
    "n87_price_gini_fit": Entry(
        lambda t: SA.price_gini_fit(*sa(t)), sens(fit_sql("pg", "year", "cprice", "gini", "year <> 2020")), FIT),
}

# ---- compliance ---------------------------------------------------------------------

SHEETS = ("sheet_co2", "sheet_luc", "sheet_non_co2", "sheet_target")


def melted(sheet):
    return f"""SELECT scenario, region, ghg, CAST(y AS INT) AS year, v AS value
        FROM {sheet} UNPIVOT INCLUDE NULLS (v FOR y IN ("2020", "2025", "2030", "2035", "2040", "2045", "2050"))"""


def compliance(body, book="sheet", mid="WHEN contains(scenario, 'MinHist') THEN 'MinHist'", **ctes):
    label = f"""CASE WHEN contains(scenario, 'Gini25') THEN 'Gini25' WHEN contains(scenario, 'Gini50') THEN 'Gini50' {mid}
        WHEN contains(scenario, 'RegGHGPol') THEN 'Baseline' ELSE scenario END"""
    cell = lambda s: f"max(value) FILTER (WHERE scenario = '{s}')"
    return side(
        [f"{book}_co2", f"{book}_luc", f"{book}_non_co2", "sheet_target"], body, **GWPCTE,
        gas=f"""{melted(book + '_non_co2')} UNION ALL
            SELECT scenario, region, 'CO2LUC', year, {strict('value')} FROM ({melted(book + '_luc')}) AS a GROUP BY scenario, region, year
            UNION ALL SELECT scenario, region, 'CO2', year, {strict('value')} FROM ({melted(book + '_co2')}) AS b
            GROUP BY scenario, region, year""",
        tot=f"""SELECT {label} AS scenario, region, year, coalesce(sum(value * gwp), 0) AS value FROM gas LEFT JOIN gw USING (ghg)
            GROUP BY scenario, region, year""",
        tgt="SELECT region, year, round_even(CAST(value AS DOUBLE), 2) AS ghg_target FROM sheet_target",
        cw=f"""SELECT x.*, ghg_target FROM (SELECT region, year, 'MtCO2e' AS Units, {cell('Baseline')} AS "Baseline",
            {cell('Gini25')} AS "Gini25", {cell('Gini50')} AS "Gini50", {cell('MinHist')} AS "MinHist" FROM tot
            GROUP BY region, year) AS x LEFT JOIN tgt USING (region, year)""", **ctes,
    )


def sheets(t):
    return CO.Sheets(*[t.side(n) for n in SHEETS])


def chart_sheets(t):
    """The chart's workbook has no lowest-history run."""
    return CO.Sheets(*[t.side(n) for n in ("chart_co2", "chart_luc", "chart_non_co2", "sheet_target")])


GAPS = " UNION ALL ".join(
    f"""SELECT region, year, Units, ghg_target, '{n}' AS scenario, ghg_target - "{c}" AS gap FROM cw"""
    for n, c in (("PCA", "Baseline"), ("Gini25", "Gini25"), ("Gini50", "Gini50"), ("MinHist", "MinHist"))
)
OTHER |= {
    "n88_totals_and_target": Entry(
        lambda t: CO.totals_and_target(sheets(t), gwp(t.spark)), compliance("SELECT * FROM cw"),
        {"Baseline": 4, "Gini25": 4, "Gini50": 4, "MinHist": 4}),
    "n89_violations": Entry(
        lambda t: CO.violations(sheets(t), gwp(t.spark)),
        compliance(f"""SELECT region, year, Units, scenario, round_even(gap, 2) AS diff_target_sce, ghg_target,
            round_even(round_even(gap, 2) / nullif(ghg_target, 0), 2) AS diff_target_sce_perc FROM ({GAPS}) AS x
            WHERE region <> 'European Free Trade Association' AND gap < 0 AND ghg_target > 0
            AND abs(round_even(round_even(gap, 2) / nullif(ghg_target, 0), 2)) > 0.02e0""")),
    "n90_target_chart": Entry(
        lambda t: CO.target_chart(chart_sheets(t), gwp(t.spark)),
        compliance("""SELECT replace(region, '_', ' ') AS region, year, 'GtCO2e' AS Units, scenario, v / 1000 AS "GHG" FROM (
            SELECT region, year, 'Gini25' AS scenario, "Gini25" AS v FROM cw UNION ALL
            SELECT region, year, 'Gini50', "Gini50" FROM cw UNION ALL SELECT region, year, 'Target', ghg_target FROM cw) AS x
            WHERE year = 2050 AND region <> 'European Free Trade Association'""", "chart"), {"GHG": 6}),
}

# ---- income distribution ---------------------------------------------------------------

GIN = ("deciles", "deciles_25", "deciles_50")
GINCTE = {
    "reg": region_rows(),
    "stack": """SELECT * REPLACE ('Baseline' AS model) FROM deciles WHERE model = 'PCA algorithm (Two Components)'
        UNION ALL BY NAME SELECT * FROM deciles_25 UNION ALL BY NAME SELECT * FROM deciles_50""",
    "named": "SELECT stack.*, region FROM stack JOIN reg USING (region_id)",
    "sh": """SELECT * FROM named WHERE sce = 'SSP2' AND region IN ('Africa_Southern', 'Brazil', 'Australia_NZ', 'Canada', 'China',
        'EU-15', 'India', 'Japan', 'Middle East', 'Russia', 'South Africa', 'USA')""",
    "st": "SELECT DISTINCT region, year, gini FROM deciles JOIN reg USING (region_id) WHERE year = 2015",
    "models": "SELECT * FROM (VALUES ('Baseline'), ('Gini25'), ('Gini50')) AS m(model)",
    "fut": """SELECT model AS scenario, region, year, gini FROM sh WHERE year > 2015
        UNION SELECT model, region, year, gini FROM st, models""",
    "chg": """SELECT scenario, region, round_even(max(gini) FILTER (WHERE year = 2050) - max(gini) FILTER (WHERE year = 2015), 2) AS value
        FROM fut WHERE year IN (2015, 2050) GROUP BY scenario, region""",
}


def files(t):
    return G.DecileFiles(t.side("deciles"), (t.side("deciles_25"), t.side("deciles_50")))


def gin(body, **ctes):
    return side(GIN, body, **GINCTE, **ctes)


PATHS = {
    "allp": """SELECT model AS scenario, sce, region, year, gini FROM named WHERE year = 2050
        UNION SELECT model, sce, region, year, gini FROM st, models, (SELECT 'SSP' || unnest(generate_series(1, 5)) AS sce) AS p""",
    "pboth": """SELECT region AS "subRegion", sce AS ssp,
        round_even(max(gini) FILTER (WHERE year = 2050) - max(gini) FILTER (WHERE year = 2015), 2) AS value
        FROM allp WHERE scenario = 'Baseline' GROUP BY region, sce
        UNION ALL SELECT region, scenario, value FROM chg WHERE scenario <> 'Baseline'""",
    "lev": """SELECT *, CASE ssp WHEN 'Gini25' THEN 1 WHEN 'Gini50' THEN 2 WHEN 'SSP1' THEN 3 WHEN 'SSP2' THEN 4 WHEN 'SSP3' THEN 5
        WHEN 'SSP4' THEN 6 WHEN 'SSP5' THEN 7 END AS ssp_level FROM pboth""",
}
CHANGED = {"value": 2}
CLASSED = {"value": 2, "class_from": 6, "class_to": 6}

INCOME = canon("Ref_SSP2", column="sce")
OTHER |= {
    "n01_lowest_gini": Entry(
        lambda t: G.lowest_gini(t.side("history"), t.side("codes").select(F.upper("iso").alias("iso"), "country_name", "continent")),
        side(["history", "codes"], """SELECT upper(h.iso) AS iso, CAST("GiniMinHist" AS DOUBLE) AS "gini_MinHist", country_name, continent
            FROM history h LEFT JOIN codes c ON c.iso = h.iso WHERE "GiniMinHist" <> '#N/A'""")),
    "n02_country_gini": Entry(
        lambda t: G.country_gini(
            t.side("compared"), t.side("codes").select(F.upper("iso").alias("iso"), "country_name", "continent"), "Base_run"),
        side(["compared", "codes"], """SELECT upper(c.iso) AS iso, year, "Gini_2015", country_name, continent, s AS scenario, gini FROM (
            SELECT iso, year, "Gini_2015", 'Baseline' AS s, "Base_run" AS gini FROM compared UNION ALL
            SELECT iso, year, "Gini_2015", 'Gini25', "Gini25" FROM compared UNION ALL
            SELECT iso, year, "Gini_2015", 'Gini50', "Gini50" FROM compared) c LEFT JOIN codes USING (iso)""")),
    "n03_decile_income": Entry(lambda t: G.decile_income(files(t), region_map(t.spark)), gin("SELECT * FROM sh")),
    "n04_start_gini": Entry(lambda t: G.start_gini(files(t), region_map(t.spark)), gin("SELECT * FROM st")),
    "n05_gini_table": Entry(
        lambda t: G.gini_table(files(t), region_map(t.spark)),
        gin("""SELECT CASE region WHEN 'Central America and Caribbean' THEN 'CAC' WHEN 'European Free Trade Association' THEN 'EFTA'
            ELSE replace(region, '_', ' ') END AS region, max(value) FILTER (WHERE scenario = 'Baseline') AS "Baseline",
            max(value) FILTER (WHERE scenario = 'Gini25') AS "Gini25", max(value) FILTER (WHERE scenario = 'Gini50') AS "Gini50"
            FROM c5 GROUP BY region""",
            f5="""SELECT model AS scenario, region, year, gini FROM sh UNION SELECT 'Baseline', region, year, gini FROM st""",
            c5="""SELECT scenario, region, round_even(max(gini) FILTER (WHERE year = 2050) - max(gini) FILTER (WHERE year = 2015), 2) AS value
                FROM f5 WHERE year IN (2015, 2050) GROUP BY scenario, region"""),
        {"Baseline": 2, "Gini25": 2, "Gini50": 2}),
    "n06_gini_path": Entry(
        lambda t: G.gini_path(files(t), region_map(t.spark)),
        gin(f"""SELECT region, year, model, gini FROM sh WHERE {WINDOW} UNION SELECT region, year, model, gini FROM st, models""")),
    "n07_gini_map": Entry(
        lambda t: G.gini_map(files(t), region_map(t.spark)),
        gin(pretty("gm7"), gm7='SELECT region AS "subRegion", scenario, value FROM chg'), CLASSED),
    "n08_income_map": Entry(
        lambda t: G.income_map(t.side("poverty")),
        side(["poverty"], f"""SELECT {INCOME} AS sce, region AS "subRegion", upper(replace(decile, 'resid_', '')) AS decile, 2050 AS year,
            "X2050" AS value, CASE {INCOME} WHEN 'Baseline' THEN 1 WHEN 'Gini25' THEN 2 WHEN 'Gini50' THEN 3 END AS sce_level,
            CASE decile WHEN 'resid_d1' THEN 1 WHEN 'resid_d5' THEN 2 WHEN 'resid_d10' THEN 3 END AS decile_level,
            CASE WHEN "X2050" < 1 THEN 0 WHEN "X2050" < 2.17 THEN 1 WHEN "X2050" < 10 THEN 2 WHEN "X2050" < 30 THEN 3
            WHEN "X2050" < 50 THEN 4 WHEN "X2050" < 70 THEN 5 WHEN "X2050" < 100 THEN 6 WHEN "X2050" < 500 THEN 7
            WHEN "X2050" < 1000 THEN 8 WHEN "X2050" >= 1000 THEN 9 END AS class
            FROM poverty WHERE NOT contains(sce, 'MinHist') AND decile IN ('resid_d1', 'resid_d5', 'resid_d10')""")),
    "n09_variant_gini_change": Entry(
        lambda t: G.variant_gini_change(files(t), region_map(t.spark)),
        gin("""SELECT region AS "subRegion", scenario AS ssp, value FROM chg WHERE scenario <> 'Baseline'"""), CHANGED),
    "n10_start_gini_all_pathways": Entry(
        lambda t: G.start_gini_all_pathways(files(t), region_map(t.spark)),
        gin("""SELECT region, year, gini, model AS scenario, sce FROM st, models,
            (SELECT 'SSP' || unnest(generate_series(1, 5)) AS sce) AS p""")),
    "n11_pathway_gini_change": Entry(
        lambda t: G.pathway_gini_change(files(t), region_map(t.spark)), gin(pretty("lev"), **PATHS), CLASSED),
}
