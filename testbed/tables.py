"""Named study tables derived from the given tables.

Each derivation is one SQL text that Spark and DuckDB both run (the few places
where the dialects differ go through `Dialect`).  Scenario, region, year,
decile and sector are read from columns of the whole fact table, so every
derived table grows with it.  Measures are whole numbers, which makes sums
independent of their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from scenlens.constants import REGIONS
from scenlens.plans import demand, emissions, energy, food, policy_cost, prices
from scenlens.sources import Project

# Declared, so that opening a table costs no job for its footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Names and labels that the derived tables must carry.
COMMODITIES = (
    "Corn", "OtherGrain", "RootTuber", "Rice", "Wheat", "Fruits", "Vegetables", "Legumes",
    "NutsSeeds", "FiberCrop", "MiscCrop", "OilCrop", "OilPalm", "Soybean", "SugarCrop",
    "OtherMeat_Fish", "Beef", "Dairy", "Pork", "Poultry", "SheepGoat", "Game",
)
FUELS = (
    "a oil", "a oil CCS", "b natural gas", "b natural gas CCS", "c coal", "c coal CCS",
    "d biomass", "d biomass CCS", "e nuclear", "f hydro", "g wind", "h solar",
    "i geothermal", "j traditional biomass", "regional biomass",
)
GASES = (
    "CH4", "CH4_AGR", "CH4_AWB", "N2O", "N2O_AGR", "HFC125", "HFC134a", "SF6", "C2F6",
    "BC", "SO2", "NOx_AWB", "CO",
)
MARKET_SHORT = {
    "Central America and Caribbean": "CAC",
    "European Free Trade Association": "EFTA",
    "South America_Northern": "SAN",
    "South America_Southern": "SAS",
}
MODEL_YEARS = tuple(range(2015, 2051, 5))
LABELS = {
    "policy": ("RegGHGPol_Ineq", "RegGHGPol_Gini25_Ineq", "RegGHGPol_Gini50_Ineq"),
    "no_policy": ("Ref_SSP2_Ineq", "Ref_SSP2_Gini25_Ineq", "Ref_SSP2_Gini50_Ineq"),
}


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def base(self, table: str) -> str:
        return "{" + table + "}" if self.spark else table

    def name(self, column: str) -> str:
        return f"`{column}`" if self.spark else f'"{column}"'

    def pick(self, values, index: str) -> str:
        """Element of a constant list at a 0-based index."""
        items = ", ".join(f"'{v}'" for v in values)
        if self.spark:
            return f"element_at(array({items}), CAST({index} + 1 AS INT))"
        return f"list_extract([{items}], CAST({index} + 1 AS INT))"

    def each(self, values) -> str:
        """One row per value of a constant list."""
        items = ", ".join(repr(v) for v in values)
        return f"explode(array({items}))" if self.spark else f"unnest([{items}])"


SPARK, DUCK = Dialect(True), Dialect(False)


def slot(date: str) -> str:
    """Model year: eleven months of the date range are five model years from 2015 on."""
    return f"CAST(2015 + 5 * floor(((year({date}) - 1995) * 12 + month({date}) - 1) / 11e0) AS INT)"


def _labels(column: str, values, labels) -> str:
    cases = " ".join(f"WHEN '{v}' THEN '{x}'" for v, x in zip(values, labels))
    return f"CASE {column} {cases} END"


def _scenario(family: str) -> str:
    if family == "sensitivity":
        return "'SA_' || CASE l_linestatus WHEN 'O' THEN 'PCA' ELSE 'LogNorm' END || '_SSP' || (l_suppkey % 5 + 1)"
    return _labels("l_returnflag", "NAR", LABELS[family])


def facts(d: Dialect, family: str) -> str:
    """Line items with the keys of the study."""
    regions = d.pick([r for _, r, _ in REGIONS], "l_orderkey % 32")
    return f"""(SELECT {_scenario(family)} AS scenario, {regions} AS region,
        l_orderkey % 32 AS rk, {slot('l_shipdate')} AS year,
        'd' || (l_partkey % 10 + 1) AS decile, l_partkey % 10 + 1 AS dk,
        l_linenumber AS ln, l_quantity AS q, l_partkey AS pk, l_suppkey AS sk
      FROM {d.base('lineitem')}) AS f"""


def every_cell(d: Dialect, family: str) -> str:
    """Line items counted per region, repeated for every scenario and model year."""
    labels = LABELS.get(family) or [f"SA_{m}_SSP{i}" for m in ("PCA", "LogNorm") for i in range(1, 6)]
    return f"""(SELECT scenario, region, {d.each(MODEL_YEARS)} AS year, n FROM (
        SELECT {d.each(labels)} AS scenario, region, n FROM (
            SELECT region, count(*) AS n FROM {facts(d, family)} GROUP BY region) AS a) AS b) AS c"""


def study_sql(name: str, d: Dialect, family: str = "policy") -> str:
    """SQL text of one named table."""
    f = facts(d, family)
    dec = "|| '_' || decile"
    if name == energy.BUILDINGS:
        return f"""SELECT scenario, region, year, CASE ln WHEN 1 THEN 'comm heating' WHEN 2 THEN 'comm cooling'
            WHEN 3 THEN 'resid heating modern' {dec} WHEN 4 THEN 'resid cooling modern' {dec}
            WHEN 5 THEN 'resid others modern' {dec} WHEN 6 THEN 'resid heating TradBio' {dec}
            ELSE 'resid other appliances' {dec} END AS sector, q AS value, 'EJ' AS Units FROM {f}"""
    if name == energy.INDUSTRY:
        label = (
            _labels("o_orderstatus", "FOP", LABELS[family]) if family != "sensitivity"
            else "'SA_' || CASE o_orderstatus WHEN 'F' THEN 'PCA' ELSE 'LogNorm' END || '_SSP' || (o_custkey % 5 + 1)"
        )
        return f"""SELECT {label} AS scenario, {d.pick([r for _, r, _ in REGIONS], 'o_orderkey % 32')} AS region,
            {slot('o_orderdate')} AS year, floor(o_totalprice / 1e3) * 1e0 AS value, 'EJ' AS Units
            FROM {d.base('orders')}"""
    if name == energy.TRANSPORT:
        return f"""SELECT scenario, region, year, CASE WHEN ln <= 2 THEN 'trn_pass_road' {dec}
            WHEN ln = 3 THEN 'trn_aviation_intl' {dec} WHEN ln <= 5 THEN 'trn_freight_road'
            ELSE 'trn_shipping_intl' END AS sector, CAST(pk % 50 + 1 AS DOUBLE) AS value, 'EJ' AS Units FROM {f}"""
    if name == energy.TRANSPORT_TOTAL:
        return f"SELECT scenario, region, year, CAST(sk % 20 + 1 AS DOUBLE) AS value, 'EJ' AS Units FROM {f}"
    if name == demand.SERVICE:
        return f"""SELECT scenario, region, year, CASE WHEN ln <= 5 THEN 'trn_pass' {dec}
            ELSE 'trn_aviation_intl' {dec} END AS sector, q * ln AS value, 'million pass-km' AS Units FROM {f}"""
    if name == energy.POPULATION:
        return f"""SELECT scenario, region, year, CAST(n + year - 2015 + length(scenario) AS DOUBLE) AS value,
            'thous' AS Units FROM {every_cell(d, family)}"""
    if name == energy.INCOME_QUERY:
        return f"""SELECT scenario, region, year, 'resid_' || decile AS consumer,
            sum(q) AS value, 'thous 1990$' AS Units FROM {f} GROUP BY scenario, region, year, decile"""
    if name == food.FOOD_DEMAND:
        return f"""SELECT scenario, region, year, 'FoodDemand_Group' || dk AS consumer,
            CASE WHEN ln <= 3 THEN 'FoodDemand_Staples' ELSE 'FoodDemand_NonStaples' END AS input,
            sum(q) AS value, 'Pcal' AS Units FROM {f}
            GROUP BY scenario, region, year, dk, CASE WHEN ln <= 3 THEN 'FoodDemand_Staples' ELSE 'FoodDemand_NonStaples' END"""
    if name == food.FOOD_TYPES:
        tech = d.pick(COMMODITIES, "sk % 22")
        return f"""SELECT scenario, region, year, {tech} AS technology, {tech} AS subsector_3,
            CASE ln WHEN 1 THEN 'NonStaples_Animal' WHEN 2 THEN 'NonStaples_Plant' WHEN 3 THEN 'FiberCrop'
            WHEN 4 THEN 'OtherGrain' WHEN 5 THEN 'RootTuber' WHEN 6 THEN 'Plant_OilCrop' ELSE 'Wheat' END AS subsector_4,
            q AS value, 'Pcal' AS Units FROM {f}"""
    if name in (energy.PRIMARY, energy.PRIMARY_AVERAGE):
        fuel = d.pick(FUELS, "sk % 15" if name == energy.PRIMARY else "pk % 15")
        return f"""SELECT scenario, region, year, {fuel} AS fuel, sum(q) AS value, 'EJ' AS Units
            FROM {f} GROUP BY scenario, region, year, {fuel}"""
    if name == energy.LAND:
        return f"""SELECT scenario, region, year, CASE ln WHEN 1 THEN 'Forest_Managed' WHEN 2 THEN 'UnmanagedForest'
            WHEN 3 THEN 'Corn' WHEN 4 THEN 'Forest_Irrigated' WHEN 5 THEN 'Grassland'
            WHEN 6 THEN 'ProtectedUnmanagedForest' END AS landleaf, q AS value, 'thous km2' AS Units FROM {f}"""
    if name == prices.PRICES:
        short = d.pick([MARKET_SHORT.get(r, r.replace(" ", "_")) for _, r, _ in REGIONS], "rk")
        market = f"""CASE ln WHEN 5 THEN 'globalCO2' WHEN 6 THEN {short} || 'CO2_LUC'
            WHEN 7 THEN {short} || 'CO2FUG' ELSE {short} || 'CO2' END"""
        return f"""SELECT scenario, {market} AS market, year, sum(q) AS value, '1990$/tC' AS Units
            FROM {f} GROUP BY scenario, {market}, year"""
    if name == emissions.CO2_SECTOR:
        return f"SELECT scenario, region, year, 's' || ln AS sector, q AS value, 'MTC' AS Units FROM {f}"
    if name == emissions.CO2_REGION:
        return f"""SELECT scenario, region, year, sum(q + 1) AS value, 'MTC' AS Units FROM {f}
            GROUP BY scenario, region, year"""
    if name == emissions.LAND_USE:
        return f"SELECT scenario, region, year, 'leaf' || ln AS landleaf, q - 20 AS value, 'MTC' AS Units FROM {f}"
    if name == emissions.NON_CO2:
        return f"""SELECT scenario, region, year, {d.pick(GASES, 'sk % 13')} AS ghg, CAST(pk % 30 AS DOUBLE) AS value,
            'Tg' AS Units FROM {f}"""
    if name == policy_cost.GDP:
        return f"""SELECT scenario, region, year, 'GDP' AS account, (n + (year - 2000) * length(scenario)) * 1e3 AS value,
            'Million1990US$' AS Units FROM {every_cell(d, family)}"""
    if name == policy_cost.COST:
        return f"""SELECT scenario, region, year, CAST(sum(ln) AS DOUBLE) AS value, 'Million1990US$' AS Units
            FROM {f} GROUP BY scenario, region, year"""
    if name == policy_cost.UNDISCOUNTED:
        return f"""SELECT scenario, region AS undiscountedcost_3, year,
            sum(CAST(sum(ln) AS DOUBLE)) OVER (PARTITION BY scenario, region) AS undiscountedcost_4
            FROM {f} GROUP BY scenario, region, year"""
    raise KeyError(name)


STUDY_TABLES = (
    energy.BUILDINGS, energy.INDUSTRY, energy.TRANSPORT, energy.TRANSPORT_TOTAL, demand.SERVICE,
    energy.POPULATION, energy.INCOME_QUERY, food.FOOD_DEMAND, food.FOOD_TYPES, energy.PRIMARY,
    energy.PRIMARY_AVERAGE, energy.LAND, prices.PRICES, emissions.CO2_SECTOR,
    emissions.CO2_REGION, emissions.LAND_USE, emissions.NON_CO2, policy_cost.GDP,
    policy_cost.COST, policy_cost.UNDISCOUNTED,
)

SEGMENTS = {
    "AUTOMOBILE": "Population|Male|Aged0-4", "BUILDING": "Population|Male|Aged5-9",
    "FURNITURE": "Population|Female|Aged0-4", "HOUSEHOLD": "Population|Female|Aged5-9",
    "MACHINERY": "Population|Female|Aged60-64",
}


def _wide_sheet(d: Dialect, gas: str, value: str, with_history: bool) -> str:
    f = facts(d, "policy")
    years = ", ".join(
        f"sum(CASE WHEN year = {y} THEN {value} END) AS {d.name(str(y))}" for y in MODEL_YEARS
    )
    label = "scenario"
    if with_history:
        label = f"CASE WHEN scenario = '{LABELS['policy'][1]}' AND ln = 7 THEN 'RegGHGPol_MinHist_Ineq' ELSE scenario END"
    return f"""SELECT {label} AS scenario, region, {gas} AS ghg, 'MT' AS unit, {years}
        FROM {f} GROUP BY {label}, region, {gas}"""


def side_sql(name: str, d: Dialect) -> str:
    """SQL text of the tables a study brings as files."""
    segment = _labels("c_mktsegment", SEGMENTS, SEGMENTS.values())
    if name == "codes":
        return f"""SELECT 'n' || n_nationkey AS iso, n_name AS country_name, r_name AS continent,
            n_nationkey % 8 + 1 AS region_id FROM {d.base('nation')} JOIN {d.base('region')} ON r_regionkey = n_regionkey"""
    if name == "demography":
        sex = f"CASE WHEN contains({segment}, 'Female') THEN 'Population|Female' ELSE 'Population|Male' END"
        years = ", ".join(f"count(*) * 1e0 + {i} AS X{y}" for i, y in enumerate(MODEL_YEARS))
        return f"""SELECT 'm' AS model, 'SSP2_v9_130115' AS scenario, 'r' AS region, 'n' || nation AS iso,
            CASE WHEN grouping(segment) = 0 THEN segment WHEN grouping(sex) = 0 THEN sex ELSE 'Population' END AS variable,
            'million' AS unit, {years}
            FROM (SELECT c_nationkey AS nation, {segment} AS segment, {sex} AS sex FROM {d.base('customer')}) AS x
            GROUP BY GROUPING SETS ((nation, segment), (nation, sex), (nation))"""
    if name == "needs":
        return f"""SELECT {segment} AS variable, 'kcal/day' AS mder_units, 2000e0 + count(*) % 500 AS mder, 0e0 AS std,
            1500e0 + count(*) % 400 AS {d.name('min')}, 2500e0 + count(*) % 900 AS {d.name('max')}
            FROM {d.base('customer')} GROUP BY {segment}"""
    if name == "history":
        return f"""SELECT 'n' || c_nationkey AS iso, 2015 AS year, CASE WHEN count(*) % 5 = 0 THEN '#N/A'
            ELSE CAST(count(*) AS VARCHAR(20)) END AS GiniMinHist FROM {d.base('customer')} GROUP BY c_nationkey"""
    if name == "compared":
        return f"""SELECT 'n' || c_nationkey AS iso, {slot('o_orderdate')} AS year, count(*) * 1e0 AS Gini_2015,
            sum(floor(o_totalprice)) * 1e0 AS Base_run, sum(floor(o_totalprice / 2)) * 1e0 AS Gini25,
            sum(floor(o_totalprice / 4)) * 1e0 AS Gini50, 1e0 AS scal_25, 2e0 AS scal_50
            FROM {d.base('orders')} JOIN {d.base('customer')} ON o_custkey = c_custkey
            GROUP BY c_nationkey, {slot('o_orderdate')}"""
    start = "WHEN year = 2015 THEN (30 + region_id) / 100e0"
    if name == "deciles":
        return f"""SELECT region_id, year, model, sce, category, sum(q) AS shares,
            CASE {start} ELSE (20 + (region_id * 7 + year + length(model) * 3 + sk5 * 5) % 45) / 100e0 END AS gini
            FROM (SELECT CAST(l_orderkey % 32 + 1 AS INT) AS region_id, {slot('l_shipdate')} AS year,
                CASE l_linestatus WHEN 'O' THEN 'PCA algorithm (Two Components)' ELSE 'Lognormal functional form' END AS model,
                'SSP' || (l_suppkey % 5 + 1) AS sce, l_suppkey % 5 AS sk5, 'd' || (l_partkey % 10 + 1) AS category,
                l_quantity AS q FROM {d.base('lineitem')}) AS x
            GROUP BY region_id, year, model, sce, sk5, category"""
    if name in ("deciles_25", "deciles_50"):
        t, p, shift = {
            "deciles_25": ("orders", "o_", 5), "deciles_50": ("lineitem", "l_", 11),
        }[name]
        date, cat = ("o_orderdate", "o_custkey") if t == "orders" else ("l_shipdate", "l_partkey")
        return f"""SELECT region_id, year, 'Gini{name[-2:]}' AS model, 'SSP2' AS sce, category, count(*) * 1e0 AS shares,
            CASE {start} ELSE (20 + (region_id * 7 + year + {shift}) % 45) / 100e0 END AS gini
            FROM (SELECT CAST({p}orderkey % 32 + 1 AS INT) AS region_id, {slot(date)} AS year,
                'd' || ({cat} % 10 + 1) AS category FROM {d.base(t)}) AS x
            GROUP BY region_id, year, category"""
    if name == "poverty":
        f = facts(d, "no_policy")
        label = "CASE WHEN ln = 7 THEN 'Ref_SSP2_MinHist' ELSE scenario END"
        years = ", ".join(f"sum(CASE WHEN year = {y} THEN q END) AS X{y}" for y in MODEL_YEARS)
        return f"""SELECT {label} AS sce, region, 'resid_' || decile AS decile, {years} FROM {f}
            GROUP BY {label}, region, decile"""
    if name.endswith(("_co2", "_luc", "_non_co2")):
        gas, value = {
            "co2": ("'CO2'", "q"), "luc": ("'CO2'", "q - 20"),
            "non_co2": (d.pick(GASES, "sk % 13"), "pk % 30 * 1e0"),
        }[name.split("_", 1)[1]]
        return _wide_sheet(d, gas, value, with_history=name.startswith("sheet"))
    if name == "sheet_target":
        f = facts(d, "policy")
        return f"""SELECT region, year, CAST(sum(q) * 2 - 500 AS VARCHAR(30)) AS value FROM {f} GROUP BY region, year"""
    if name == "price_index":
        return f"""SELECT CASE WHEN year(o_orderdate) = 1995 THEN 1990 ELSE year(o_orderdate) + 14 END AS year,
            sum(floor(o_totalprice)) / count(*) AS {d.name('index')} FROM {d.base('orders')} GROUP BY year(o_orderdate)"""
    raise KeyError(name)


class Testbed:
    """Derived tables as Spark DataFrames."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._opened: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        if table not in self._opened:
            self._opened[table] = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.dir}/{table}.parquet")
        return self._opened[table]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.base(t) for t in SCHEMAS if "{" + t + "}" in text})

    def project(self, family: str = "policy") -> Project:
        return Project({
            name: (lambda n=name: self.sql(study_sql(n, SPARK, family))) for name in STUDY_TABLES
        })

    def side(self, name: str) -> DataFrame:
        return self.sql(side_sql(name, SPARK))
