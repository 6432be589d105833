"""Energy and food results with their oracles."""

from __future__ import annotations

from scenlens import scenarios as S
from scenlens.plans import energy as E
from scenlens.plans import food as D
from scenlens.sources import food_groups, region_map
from testbed.entry import (
    WINDOW, Entry, canon, display, kmeans, long, number_text, pretty, region_rows, strict, study, wide,
)

BLD = {"bld": E.BUILDINGS}
IND = {"ind": E.INDUSTRY}
TRN = {"trn": E.TRANSPORT}
ALL = {**BLD, **IND, **TRN}

BLD_SECTOR = """CASE WHEN contains(sector, 'comm') THEN 'Commercial Buildings'
    WHEN contains(sector, 'resid heating') THEN 'Residential heating'
    WHEN contains(sector, 'resid cooling') THEN 'Residential cooling'
    WHEN contains(sector, 'resid other') THEN 'Residential non-thermal services' ELSE sector END"""
TRN_SECTOR = """CASE WHEN contains(sector, 'trn_aviation') THEN 'International Aviation (pass)'
    WHEN contains(sector, 'trn_pass_') THEN 'Passenger transport'
    WHEN contains(sector, 'trn_freight') THEN 'Freight transport'
    WHEN contains(sector, 'trn_shipping_intl') THEN 'International shipping (freight)' ELSE sector END"""


def by_sector(src: str, sector: str) -> str:
    return f"""SELECT scenario, {sector} AS sector, year, Units, {strict('value')} AS value
        FROM {src} GROUP BY scenario, {sector}, year, Units"""


SECTORS = f"{by_sector('bld', BLD_SECTOR)} UNION ALL {by_sector('ind', chr(39) + 'Industry' + chr(39))} UNION ALL {by_sector('trn', TRN_SECTOR)}"
SECTORS_TOTAL = f"{by_sector('bld', BLD_SECTOR)} UNION ALL {by_sector('ind', chr(39) + 'Industry' + chr(39))} UNION ALL {by_sector('trn', chr(39) + 'Transport' + chr(39))}"


def named(src: str, base: str = "RegGHGPol_Ineq", label: str = "Baseline", where: str = "true") -> str:
    return f"SELECT * REPLACE ({canon(base, label)} AS scenario) FROM {src} WHERE {where}"


def label_of(value: str) -> str:
    return f"{number_text(value, 1)} || ' %'"


def _final(body, base="RegGHGPol_Ineq", family="policy", sectors=SECTORS, where=WINDOW, tables=ALL, **ctes):
    return study(tables, body, family, sec=sectors, fen=named("sec", base, where=where), **ctes)


NOPOL_TABLES = {**BLD, **IND, "trn": E.TRANSPORT_TOTAL}
NOPOL = {"base": "Ref_SSP2", "family": "no_policy", "sectors": SECTORS_TOTAL, "tables": NOPOL_TABLES}


def labelled_sql(suffix="", **kw):
    return _final(
        f"""SELECT t.year, t.scenario, t.total_value, r.annual_change, {label_of('r.annual_change')} AS label
        FROM (SELECT year, scenario, {strict('value')} AS total_value FROM l GROUP BY year, scenario) t
        LEFT JOIN r ON r.year = t.year AND r.scenario = t.scenario""",
        w=wide("fen", "year, sector, Units"), l=long("w", "year, sector, Units", suffix=suffix),
        wt=wide("fen", "year"), r=long("wt", "year", "percent", "annual_change", suffix), **kw,
    )


def relative_sql(suffix="", **kw):
    return _final(
        f"SELECT *, {label_of('annual_change')} AS label FROM r",
        wt=wide("fen", "year"), r=long("wt", "year", "percent", "annual_change", suffix), **kw,
    )


ENERGY: dict[str, Entry] = {
    "n12_income_deciles": Entry(
        lambda t: E.income_deciles(t.project()),
        study({"inc": E.INCOME_QUERY}, """SELECT DISTINCT replace(consumer, 'resid_', '') AS decile
            FROM inc WHERE contains(consumer, 'resid')"""),
    ),
    "n13_buildings_energy": Entry(lambda t: E.buildings_energy(t.project()), study(BLD, by_sector("bld", BLD_SECTOR))),
    "n14_industry_energy": Entry(lambda t: E.industry_energy(t.project()), study(IND, by_sector("ind", "'Industry'"))),
    "n15_transport_energy": Entry(lambda t: E.transport_energy(t.project()), study(TRN, by_sector("trn", TRN_SECTOR))),
    "n16_final_energy_change": Entry(
        lambda t: E.final_energy_change(t.project()),
        _final(long("w", "year, sector, Units"), w=wide("fen", "year, sector, Units")),
    ),
    "n17_final_energy_levels": Entry(
        lambda t: E.final_energy_levels(t.project()),
        _final("SELECT scenario, sector, year, Units, value FROM fen", where="year IN (2015, 2030, 2050)"),
    ),
    "n17_final_energy_chart": Entry(
        lambda t: E.final_energy_chart(t.project()),
        _final("""SELECT scenario, sector, year, Units, value, CASE sector WHEN 'Commercial Buildings' THEN 1 WHEN 'Residential cooling' THEN 2
            WHEN 'Residential heating' THEN 3 WHEN 'Residential non-thermal services' THEN 4 WHEN 'Industry' THEN 5
            WHEN 'Passenger transport' THEN 6 WHEN 'International Aviation (pass)' THEN 7 WHEN 'Freight transport' THEN 8
            WHEN 'International shipping (freight)' THEN 9 END AS sector_level FROM fen""", where="year IN (2015, 2030, 2050)"),
    ),
    "n18_final_energy_totals": Entry(
        lambda t: E.final_energy_totals(t.project()),
        _final("""SELECT year, b AS "Baseline", g25 AS "Gini25", g50 AS "Gini50", g25 - b AS "diff_Gini25",
            g50 - b AS "diff_Gini50", (g25 - b) / nullif(b, 0) * 100 AS "diff_Gini25_perc",
            (g50 - b) / nullif(b, 0) * 100 AS "diff_Gini50_perc" FROM w""",
            where="year IN (2015, 2030, 2050)", w=wide("fen", "year")),
    ),
    "n19_final_energy_relative": Entry(lambda t: E.final_energy_relative(t.project()), relative_sql()),
    "n20_final_energy_labelled": Entry(lambda t: E.final_energy_labelled(t.project()), labelled_sql()),
    "n76_final_energy_change_no_policy": Entry(
        lambda t: E.final_energy_change(t.project("no_policy"), S.NO_POLICY, by_mode=False),
        _final(long("w", "year, sector, Units", suffix="_NoClimPol"), w=wide("fen", "year, sector, Units"), **NOPOL),
    ),
    "n76_transport_total_no_policy": Entry(
        lambda t: E.transport_total_energy(t.project("no_policy")),
        study({"trn": E.TRANSPORT_TOTAL}, by_sector("trn", "'Transport'"), "no_policy"),
    ),
    "n77_final_energy_relative_no_policy": Entry(
        lambda t: E.final_energy_relative(t.project("no_policy"), S.NO_POLICY, by_mode=False),
        relative_sql("_NoClimPol", **NOPOL),
    ),
    "n77_final_energy_labelled_no_policy": Entry(
        lambda t: E.final_energy_labelled(t.project("no_policy"), S.NO_POLICY, by_mode=False),
        labelled_sql("_NoClimPol", **NOPOL),
    ),
}

# ---- deciles -------------------------------------------------------------

DEC = "CASE WHEN regexp_matches(sector, '_d[0-9]+$') THEN regexp_extract(sector, '_(d[0-9]+)$', 1) END"
STEM = "regexp_replace(sector, '_d[0-9]+$', '')"


def by_decile(src: str, recode: str, where: str) -> str:
    return f"""SELECT scenario, region, sector2 AS sector, decile, year, Units, {strict('value')} AS value FROM (
        SELECT *, {recode} AS sector2, {DEC} AS decile
        FROM {src} WHERE {where}) AS x GROUP BY scenario, region, sector2, decile, year, Units"""


RES_SECTOR = f"""CASE WHEN contains(sector, 'resid heating') THEN 'Residential heating'
    WHEN contains(sector, 'resid cooling') THEN 'Residential cooling'
    WHEN contains(sector, 'resid other') THEN 'Residential non-thermal services' ELSE {STEM} END"""
PASS_SECTOR = f"""CASE WHEN contains(sector, 'trn_aviation') THEN 'International Aviation (pass)'
    WHEN contains(sector, 'trn_pass') THEN 'Passenger transport' ELSE {STEM} END"""
BLD_DEC = by_decile("bld", RES_SECTOR, "contains(sector, 'resid')")
TRN_DEC = by_decile("trn", PASS_SECTOR, "contains(sector, 'trn_pass') OR contains(sector, 'trn_aviation')")
DEC_TABLES = {**BLD, **TRN, "people": E.POPULATION, "inc": E.INCOME_QUERY}
REG = {"reg": region_rows()}
POP = {
    "pop0": f"SELECT {canon()} AS scenario, region, year, value * 1000 AS value FROM people",
    "pop": f"""SELECT scenario, region_agg AS region, year, {strict('value')} AS pop
        FROM pop0 JOIN reg USING (region) GROUP BY scenario, region_agg, year""",
    "popdec": """SELECT scenario, region, year, decile, value * 1 / n AS pop FROM pop0,
        (SELECT DISTINCT replace(consumer, 'resid_', '') AS decile FROM inc
            WHERE contains(consumer, 'resid')) d,
        (SELECT count(DISTINCT consumer) AS n FROM inc WHERE contains(consumer, 'resid')) c""",
}


def roll(src: str, keys: str, value: str = "value") -> str:
    """Strict sum with region replaced by its aggregate."""
    columns = ", ".join("region_agg AS region" if k.strip() == "region" else k for k in keys.split(","))
    group = ", ".join("region_agg" if k.strip() == "region" else k for k in keys.split(","))
    return f"SELECT {columns}, {strict(value)} AS {value} FROM {src} JOIN reg USING (region) GROUP BY {group}"


DECCTE = {
    **REG, **POP,
    "dec0": f"{BLD_DEC} UNION ALL {TRN_DEC}",
    "dec1": named("dec0"),
}
SHORT = """replace(replace(replace(sector, 'Residential', 'Resid'), ' services', ''), 'International', 'Int.')"""

ENERGY |= {
    "n21_buildings_by_decile": Entry(lambda t: E.buildings_by_decile(t.project()), study(BLD, BLD_DEC)),
    "n22_transport_by_decile": Entry(lambda t: E.transport_by_decile(t.project()), study(TRN, TRN_DEC)),
    "n23_population_aggregate": Entry(
        lambda t: E.population_aggregate(t.project(), region_map(t.spark)),
        study(DEC_TABLES, "SELECT * FROM pop", **REG, **POP),
    ),
    "n24_decile_energy_change": Entry(
        lambda t: E.decile_energy_change(t.project(), region_map(t.spark)),
        study(DEC_TABLES, f"""SELECT r.scenario, {display('r.region')} AS region, r.year, r.decile, {SHORT} AS sector,
            r.value, pop, r.value * 1e9 / nullif(pop, 0) AS value_pc
            FROM r JOIN pop ON pop.scenario = r.scenario AND pop.region = r.region AND pop.year = r.year""",
            **DECCTE, d=f"SELECT * FROM dec1 WHERE {WINDOW}",
            w=wide("d", "year, region, decile, sector, Units"),
            l=long("w", "year, region, decile, sector, Units"),
            r=roll("l", "scenario, region, year, decile, sector")),
    ),
    "n24_decile_energy_chart": Entry(
        lambda t: E.decile_energy_chart(t.project(), region_map(t.spark)),
        study(DEC_TABLES, f"""SELECT r.scenario, {display('r.region')} AS region, r.year, upper(r.decile) AS decile, {SHORT} AS sector,
            r.value, pop, r.value * 1e9 / nullif(pop, 0) AS value_pc,
            CASE WHEN regexp_matches(r.decile, '^d([1-9]|10)$') THEN CAST(replace(r.decile, 'd', '') AS INTEGER) END AS decile_level
            FROM r JOIN pop ON pop.scenario = r.scenario AND pop.region = r.region AND pop.year = r.year WHERE r.year = 2050""",
            **DECCTE, d=f"SELECT * FROM dec1 WHERE {WINDOW}",
            w=wide("d", "year, region, decile, sector, Units"),
            l=long("w", "year, region, decile, sector, Units"),
            r=roll("l", "scenario, region, year, decile, sector")),
    ),
    "n25_population_by_decile": Entry(
        lambda t: E.population_by_decile(t.project()),
        study(DEC_TABLES, "SELECT * FROM popdec", **REG, **POP),
    ),
    "n26_income_growth_poorest": Entry(
        lambda t: E.income_growth_poorest(t.project()),
        study({"inc": E.INCOME_QUERY}, f"""SELECT {canon()} AS scenario, region, 'd1' AS decile,
            max(value) FILTER (WHERE year = 2050) / nullif(max(value) FILTER (WHERE year = 2020), 0) AS gdp_pc_change
            FROM inc WHERE consumer = 'resid_d1' AND year IN (2020, 2050) GROUP BY 1, region"""),
    ),
    "n27_poorest_energy_growth": Entry(
        lambda t: E.poorest_energy_growth(t.project()),
        study(DEC_TABLES, """SELECT a.*, a.y2050 / nullif(a.y2020, 0) AS change, g.gdp_pc_change FROM a JOIN g USING (scenario, region, decile)""",
            **DECCTE,
            p="""SELECT d.*, d.value * 1e9 / nullif(pop, 0) AS value_pc FROM dec1 d JOIN popdec USING (scenario, region, decile, year)
                WHERE decile = 'd1' AND year IN (2020, 2050)""",
            a="""SELECT scenario, region, sector, decile, Units, max(value_pc) FILTER (WHERE year = 2020) AS y2020,
                max(value_pc) FILTER (WHERE year = 2050) AS y2050 FROM p GROUP BY scenario, region, sector, decile, Units""",
            g=f"""SELECT {canon()} AS scenario, region, 'd1' AS decile,
                max(value) FILTER (WHERE year = 2050) / nullif(max(value) FILTER (WHERE year = 2020), 0) AS gdp_pc_change
                FROM inc WHERE consumer = 'resid_d1' AND year IN (2020, 2050) GROUP BY 1, region"""),
    ),
    "n28_energy_per_person": Entry(
        lambda t: E.energy_per_person(t.project(), region_map(t.spark)),
        study(DEC_TABLES, f"""SELECT r.scenario, {display('r.region')} AS region, r.year, r.decile, r.value, pop,
            r.value * 1e9 / nullif(pop * 0.1e0, 0) AS value_pc
            FROM r JOIN pop ON pop.scenario = r.scenario AND pop.region = r.region AND pop.year = r.year""",
            **DECCTE, d=f"SELECT * FROM dec1 WHERE {WINDOW}", r=roll("d", "scenario, region, year, decile")),
    ),
    "n28_energy_need_chart": Entry(
        lambda t: E.energy_need_chart(t.project(), region_map(t.spark)),
        study(DEC_TABLES, f"""SELECT r.scenario, {display('r.region')} AS region, r.year, r.decile, r.value, pop,
            r.value * 1e9 / nullif(pop * 0.1e0, 0) AS value_pc, 16e0 AS need
            FROM r JOIN pop ON pop.scenario = r.scenario AND pop.region = r.region AND pop.year = r.year
            WHERE r.year = 2050 AND r.decile = 'd1'""",
            **DECCTE, d=f"SELECT * FROM dec1 WHERE {WINDOW}", r=roll("d", "scenario, region, year, decile")),
    ),
    "n29_aviation_change": Entry(
        lambda t: E.aviation_change(t.project(), region_map(t.spark)),
        study(TRN, "SELECT * REPLACE (replace(region, '_', ' ') AS region) FROM r",
            **REG, dec0=TRN_DEC, d=named("dec0", where=f"contains(sector, 'Aviation') AND {WINDOW}"),
            w=wide("d", "year, region, decile, sector, Units"), l=long("w", "year, region, decile, sector, Units"),
            r=roll("l", "scenario, region, year, decile, sector")),
    ),
}


def fuel_sql(where: str, body: str = "SELECT * FROM r", tables=None, family="policy", base="RegGHGPol_Ineq", suffix="", **ctes) -> str:
    return study(
        tables or {"en": E.PRIMARY}, body, family, **REG, d=named("en", base, where=f"{where} AND {WINDOW}"),
        w=wide("d", "year, region, fuel, Units"), l=long("w", "year, region, fuel, Units", suffix=suffix),
        r=roll("l", "scenario, region, fuel, year, Units"), **ctes,
    )


ENERGY |= {
    "n30_primary_energy_change": Entry(
        lambda t: E.primary_energy_change(t.project(), region_map(t.spark)),
        fuel_sql("fuel <> 'regional biomass'", "SELECT r.*, pop FROM r JOIN pop USING (scenario, region, year)",
            {"en": E.PRIMARY, "people": E.POPULATION, "inc": E.INCOME_QUERY}, **POP),
    ),
    "n31_ccs_change": Entry(
        lambda t: E.ccs_change(t.project(), region_map(t.spark)), fuel_sql("contains(fuel, 'CCS')"),
    ),
    "n32_clean_energy_change": Entry(
        lambda t: E.clean_energy_change(t.project()),
        study({"en": E.PRIMARY, "av": E.PRIMARY_AVERAGE},
            'SELECT year, fuel, Units, g25 - b AS "diff_Gini25", g50 - b AS "diff_Gini50" FROM w',
            u="""SELECT * FROM av WHERE NOT contains(fuel, 'coal') AND NOT contains(fuel, 'oil') AND NOT contains(fuel, 'gas')
                UNION ALL BY NAME SELECT * FROM en WHERE contains(fuel, 'CCS')""",
            d=named("u", where="year = 2050"), w=wide("d", "year, fuel, Units")),
    ),
    "n33_managed_forest_change": Entry(
        lambda t: E.managed_forest_change(t.project()),
        study({"land": E.LAND}, 'SELECT year, Units, g25 - b AS "diff_Gini25", g50 - b AS "diff_Gini50" FROM w',
            d=named("land", where="contains(landleaf, 'Forest') AND NOT contains(landleaf, 'Unmanaged') AND year = 2050"),
            w=wide("d", "year, Units")),
    ),
    "n78_primary_energy_change_no_policy": Entry(
        lambda t: E.primary_energy_change(t.project("no_policy"), region_map(t.spark), S.NO_POLICY_INEQ, with_population=False),
        fuel_sql("fuel <> 'regional biomass'", family="no_policy", base="Ref_SSP2_Ineq", suffix="_NoClimPol"),
    ),
}

# ---- food ------------------------------------------------------------------

TYPES = {"ft": D.FOOD_TYPES}
STAPLE = "CASE WHEN subsector IN ('Corn', 'Rice', 'RootTuber', 'Wheat', 'OtherGrain') THEN 'Staples' ELSE 'Non-staples' END"


def commodity(base="RegGHGPol_Ineq", suffix="") -> dict[str, str]:
    return {
        "ft2": "SELECT * RENAME (technology AS subsector) FROM ft",
        "com": named("ft2", base, where=WINDOW),
        "cw": wide("com", "year, subsector, Units"),
        "cl": f"SELECT *, {STAPLE} AS sector FROM ({long('cw', 'year, subsector, Units', suffix=suffix)}) AS x",
    }


DEMAND = {"fd": D.FOOD_DEMAND}
ROWS = {
    "rows": f"""SELECT {canon()} AS scenario, region, year, replace(split_part(consumer, '_', 2), 'Group', 'd') AS decile,
        split_part(input, '_', 2) AS demand, value, Units FROM fd WHERE {WINDOW}""",
}
COMPLETE = "WHERE total_value IS NOT NULL AND annual_change IS NOT NULL AND sector IS NOT NULL AND label IS NOT NULL"
LEVEL = "CASE t.sector WHEN 'Staples' THEN 1 WHEN 'Non-staples' THEN 2 END AS sector_level"
PATCH = """CASE WHEN "subRegion" = 'Central Asia' AND year = 2050 AND demand = 'NonStaples' THEN 0e0 ELSE value END"""
SUBSECTOR = """CASE WHEN contains(subsector_4, 'Oil') OR contains(subsector_4, 'Sugar') OR contains(subsector_4, 'Root')
    OR contains(subsector_4, 'OtherGrain') OR contains(subsector_4, 'MiscCrop') OR contains(subsector_4, 'FiberCrop') THEN 'Other crops'
    WHEN contains(subsector_4, 'Plant') THEN 'Plant protein' WHEN contains(subsector_4, 'Animal') THEN 'Animal protein'
    ELSE subsector_3 END"""
SUBCTE = {
    "sub": f"SELECT {canon()} AS scenario, region, year, {SUBSECTOR} AS subsector, Units, value FROM ft WHERE {WINDOW}",
    "sw": wide("sub", "year, region, subsector, Units"),
}
PEOPLE = {"people": E.POPULATION, "inc": E.INCOME_QUERY}
POPAGG = {**REG, **POP, "pd": roll("popdec", "scenario, region, decile, year", "pop")}
REL_FOOD = {
    "dw": wide("rows", "year, demand"),
    "fr": f"""SELECT year, replace(demand, 'NonStaples', 'Non-staples') AS demand, scenario, annual_change,
        {label_of('annual_change')} AS label FROM ({long('dw', 'year, demand', 'percent', 'annual_change')}) AS x""",
}
TOTALS = {"tot": f"SELECT scenario, year, sector, {strict('value')} AS total_value FROM cl GROUP BY scenario, year, sector"}

GROUP_ROWS = """(VALUES ('Corn', 'Staple Grains'), ('OtherGrain', 'Staple Grains'), ('RootTuber', 'Staple Grains'),
    ('Rice', 'Staple Grains'), ('Wheat', 'Staple Grains'), ('Fruits', 'Fruit&Veg'), ('Vegetables', 'Fruit&Veg'),
    ('Legumes', 'Plant Protein'), ('NutsSeeds', 'Plant Protein'), ('FiberCrop', 'Other Crops'), ('MiscCrop', 'Other Crops'),
    ('OilCrop', 'Oil Crops'), ('OilPalm', 'Oil Crops'), ('Soybean', 'Oil Crops'), ('SugarCrop', 'Oil Crops'),
    ('OtherMeat_Fish', 'Animal Protein'), ('Beef', 'Animal Protein'), ('Dairy', 'Animal Protein'),
    ('Pork', 'Animal Protein'), ('Poultry', 'Animal Protein'), ('SheepGoat', 'Animal Protein')) AS g(subsector, food_group)"""

FOOD: dict[str, Entry] = {
    "n34_commodity_change": Entry(
        lambda t: D.commodity_change(t.project()), study(TYPES, "SELECT * FROM cl", **commodity())),
    "n35_staple_change": Entry(
        lambda t: D.staple_change(t.project()),
        study(TYPES, f"SELECT scenario, sector, year, Units, {strict('value')} AS value FROM cl GROUP BY ALL", **commodity())),
    "n36_commodity_levels": Entry(
        lambda t: D.commodity_levels(t.project()),
        study(TYPES, f"""SELECT {canon()} AS scenario, technology AS subsector, year, Units, {strict('value')} AS value
            FROM ft WHERE year IN (2015, 2030, 2050) GROUP BY 1, 2, year, Units""")),
    "n37_food_relative": Entry(
        lambda t: D.food_relative(t.project()), study(DEMAND, "SELECT * FROM fr", **ROWS, **REL_FOOD)),
    "n38_food_labelled": Entry(
        lambda t: D.food_labelled(t.project()),
        study({**TYPES, **DEMAND}, f"""SELECT t.scenario, t.year, t.sector, total_value, annual_change, label, {LEVEL}
            FROM tot t LEFT JOIN fr ON fr.year = t.year AND fr.scenario = t.scenario AND fr.demand = t.sector {COMPLETE}""",
            **commodity(), **TOTALS, **ROWS, **REL_FOOD)),
    "n39_food_group_change": Entry(
        lambda t: D.food_group_change(t.project(), food_groups(t.spark)),
        study(TYPES, f"""SELECT scenario, year, sector, food_group, {strict('value')} AS value
            FROM cl LEFT JOIN {GROUP_ROWS} USING (subsector) GROUP BY ALL""", **commodity())),
    "n40_food_change": Entry(
        lambda t: D.food_change(t.project()),
        study(DEMAND, long("w", "year, region, demand, decile, Units"), **ROWS, w=wide("rows", "year, region, demand, decile, Units"))),
    "n41_food_map": Entry(
        lambda t: D.food_map(t.project()),
        study(DEMAND, kmeans("km", among="year = 2050"), **ROWS,
            w=wide("rows", "year, region, demand, decile, Units"), l=long("w", "year, region, demand, decile, Units"),
            m=f"""SELECT scenario AS sce, region AS "subRegion", year, demand, Units, {strict('value')} AS value
                FROM l GROUP BY scenario, region, year, demand, Units""", km=f"SELECT * REPLACE ({PATCH} AS value) FROM m")),
    "n42_food_percent": Entry(
        lambda t: D.food_percent(t.project()),
        study(DEMAND, pretty("pm", "year = 2050"), **ROWS,
            w=wide("rows", "year, region, demand, Units"), l=long("w", "year, region, demand, Units", "percent"),
            m="""SELECT scenario AS sce, region AS "subRegion", year, demand, value, '%' AS Units FROM l""",
            pm=f"SELECT * REPLACE ({PATCH} AS value) FROM m")),
    "n43_food_subsector_change": Entry(
        lambda t: D.food_subsector_change(t.project()),
        study(TYPES, long("sw", "year, region, subsector, Units"), **SUBCTE)),
    "n43_food_subsector_map": Entry(
        lambda t: D.food_subsector_map(t.project()),
        study(TYPES, kmeans("km", among="year = 2050"), **SUBCTE, l=long("sw", "year, region, subsector, Units"),
            km='SELECT * RENAME (scenario AS sce, region AS "subRegion") FROM l')),
    "n44_population_decile_aggregate": Entry(
        lambda t: D.population_decile_aggregate(t.project(), region_map(t.spark)),
        study(PEOPLE, "SELECT * FROM pd", **POPAGG), {"pop": 6}),
    "n45_intake_change": Entry(
        lambda t: D.intake_change(t.project(), region_map(t.spark)),
        study({**DEMAND, **PEOPLE}, f"SELECT * REPLACE ({display()} AS region) FROM l", **ROWS, **POPAGG,
            r=roll("rows", "scenario, region, decile, demand, year, Units"),
            k="SELECT r.* REPLACE (value * 1e12 / nullif(pop, 0) / 365 AS value, 'kcal/day' AS Units) FROM r JOIN pd USING (year, region, decile, scenario)",
            w=wide("k", "year, region, demand, decile, Units"), l=long("w", "year, region, demand, decile, Units")),
        {"value": 2}),
    "n53_intake_level": Entry(
        lambda t: D.intake_level(t.project(), region_map(t.spark)),
        study({**DEMAND, **PEOPLE}, f"""SELECT r.scenario, {display('r.region')} AS region, r.decile, r.year,
            value * 1e12 / nullif(pop, 0) / 365 AS value, 'kcal/day' AS Units, pop
            FROM r JOIN pd USING (year, region, decile, scenario)""", **ROWS, **POPAGG,
            r=roll("rows", "scenario, region, decile, year, Units")),
        {"value": 2, "pop": 6}),
    "n79_commodity_change_no_policy": Entry(
        lambda t: D.commodity_change(t.project("no_policy"), S.NO_POLICY),
        study(TYPES, "SELECT * FROM cl", "no_policy", **commodity("Ref_SSP2", "_NoClimPol"))),
    "n79_staple_change_no_policy": Entry(
        lambda t: D.staple_change(t.project("no_policy"), S.NO_POLICY),
        study(TYPES, f"SELECT scenario, sector, year, Units, {strict('value')} AS value FROM cl GROUP BY ALL", "no_policy",
            **commodity("Ref_SSP2", "_NoClimPol"))),
}
STAPLE_REL = {
    "fs": f"SELECT *, {STAPLE} AS sector FROM com",
    "fw": wide("fs", "year, sector, Units"),
    "fr": f"""SELECT year, sector, scenario, annual_change, {label_of('annual_change')} AS label
        FROM ({long('fw', 'year, sector, Units', 'percent', 'annual_change', '_NoClimPol')}) AS x""",
}
FOOD |= {
    "n80_staple_relative_no_policy": Entry(
        lambda t: D.staple_relative(t.project("no_policy"), S.NO_POLICY),
        study(TYPES, "SELECT * FROM fr", "no_policy", **commodity("Ref_SSP2", "_NoClimPol"), **STAPLE_REL)),
    "n80_staple_labelled_no_policy": Entry(
        lambda t: D.staple_labelled(t.project("no_policy"), S.NO_POLICY),
        study(TYPES, f"""SELECT t.scenario, t.year, t.sector, total_value, annual_change, label, {LEVEL}
            FROM tot t LEFT JOIN fr ON fr.year = t.year AND fr.scenario = t.scenario AND fr.sector = t.sector
            {COMPLETE.replace('sector IS', 't.sector IS')}""", "no_policy",
            **commodity("Ref_SSP2", "_NoClimPol"), **TOTALS, **STAPLE_REL)),
}
