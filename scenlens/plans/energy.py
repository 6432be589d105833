"""Final and primary energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import (
    alnum_piece,
    contains,
    number_text,
    ordinal,
    recode_first,
    safe_div,
    split_decile,
)
from scenlens.operators import (
    change,
    compare,
    net_and_relative,
    pivot_cells,
    pivot_sums,
    split_equally,
    spread,
    strict_lookup,
    sum_by,
    to_aggregate_region,
    union_all,
    year_window,
)
from scenlens.scenarios import POLICY, ScenarioFamily
from scenlens.sources import Project

BUILDINGS = "building final energy by service and fuel"
INDUSTRY = "industry total final energy by service"
TRANSPORT = "transport final energy by mode and fuel"
TRANSPORT_TOTAL = "transport total final energy by region"
INCOME_QUERY = "subregional income"
POPULATION = "Population by region"
PRIMARY = "primary energy consumption with CCS by region (direct equivalent)"
PRIMARY_AVERAGE = "primary energy consumption by region (avg fossil efficiency)"
LAND = "detailed land allocation"

SECTOR_KEYS = ["scenario", "sector", "year", "Units"]


def display_region(region: Column | str = "region") -> Column:
    """Region name as printed: blanks for underscores, two short names."""
    spaced = F.translate(region, "_", " ")
    return recode_first(spaced, [("has", "Caribbean", "CAC"), ("has", "Trade", "EFTA")])


def income_deciles(prj: Project) -> DataFrame:
    """Distinct decile labels of the residential consumers.  N12"""
    income = prj.query(INCOME_QUERY, "consumer")
    return (
        income.where(contains("consumer", "resid"))
        .select(F.replace("consumer", F.lit("resid_"), F.lit("")).alias("decile"))
        .distinct()
    )


def _source(prj: Project, query: str, labelled: bool, source: str) -> DataFrame:
    """A table of world energy beside a tag; one without sectors has none."""
    rows = prj.query(query, *(["sector"] if labelled else []))
    sector = F.col("sector") if labelled else F.lit(None).cast("string")
    return rows.select("scenario", sector.alias("sector"), "year", "Units", "value", F.lit(source).alias("source"))


def _buildings(prj: Project) -> DataFrame:
    return _source(prj, BUILDINGS, True, "buildings")


def _industry(prj: Project) -> DataFrame:
    return _source(prj, INDUSTRY, False, "industry")


def _transport(prj: Project) -> DataFrame:
    return _source(prj, TRANSPORT, True, "transport")


def _transport_total(prj: Project) -> DataFrame:
    return _source(prj, TRANSPORT_TOTAL, False, "transport total")


def _world(*tables: DataFrame) -> DataFrame:
    """World sums of tagged tables by raw label, all in one exchange, then the label rewritten as its table asks."""
    summed = sum_by(union_all(*tables), ["source", *SECTOR_KEYS])
    named = (
        F.when(F.col("source") == "buildings", recode_first("sector", C.BUILDING_SECTORS))
        .when(F.col("source") == "transport", recode_first("sector", C.TRANSPORT_SECTORS))
        .when(F.col("source") == "industry", "Industry").otherwise("Transport")
    )
    return summed.withColumn("sector", named).drop("source")


def buildings_energy(prj: Project) -> DataFrame:
    """World energy of buildings by service.  N13, N76"""
    return sum_by(_world(_buildings(prj)), SECTOR_KEYS)


def industry_energy(prj: Project) -> DataFrame:
    """World energy of industry.  N14, N76"""
    return _world(_industry(prj))


def transport_energy(prj: Project) -> DataFrame:
    """World energy of transport by mode.  N15"""
    return sum_by(_world(_transport(prj)), SECTOR_KEYS)


def transport_total_energy(prj: Project) -> DataFrame:
    """World energy of transport as one sector.  N76"""
    return _world(_transport_total(prj))


def _all_sectors(prj: Project, by_mode: bool) -> DataFrame:
    return _world(_buildings(prj), _industry(prj), _transport(prj) if by_mode else _transport_total(prj))


def final_energy_change(prj: Project, family: ScenarioFamily = POLICY, by_mode: bool = True) -> DataFrame:
    """Change of energy by sector and year.  N16, N76 (`by_mode=False`)"""
    return compare(year_window(_all_sectors(prj, by_mode)), ["year", "sector", "Units"], family)


def final_energy_levels(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Energy by sector in the level years.  N17"""
    rows = _all_sectors(prj, True).where(F.col("year").isin(*C.LEVEL_YEARS))
    return sum_by(rows.withColumn("scenario", family.canonical()), SECTOR_KEYS)


def final_energy_chart(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """`final_energy_levels` with the drawing order of its sectors.  N17"""
    return final_energy_levels(prj, family).withColumn("sector_level", ordinal("sector", C.FINAL_ENERGY_LEVELS))


def final_energy_totals(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Total energy per scenario with absolute and relative change.  N18"""
    rows = _all_sectors(prj, True).where(F.col("year").isin(*C.LEVEL_YEARS))
    wide = spread(rows, ["year"], family, cells="merged")
    base = F.col(family.baseline)
    return wide.select(
        "year", *family.names,
        *[change("abs", F.col(v), base).alias(f"diff_{v}") for v in family.variants],
        *[change("percent", F.col(v), base).alias(f"diff_{v}_perc") for v in family.variants],
    )


def percent_label(value: Column | str) -> Column:
    """`2.5 %`; NULL when there is no value."""
    return F.concat(number_text(value, 1), F.lit(" %"))


def final_energy_relative(prj: Project, family: ScenarioFamily = POLICY, by_mode: bool = True) -> DataFrame:
    """Relative change of the total per year, with its label.  N19, N77"""
    rows = year_window(_all_sectors(prj, by_mode))
    return compare(rows, ["year"], family, "percent", out="annual_change", cells="merged").withColumn(
        "label", percent_label("annual_change")
    )


def final_energy_labelled(prj: Project, family: ScenarioFamily = POLICY, by_mode: bool = True) -> DataFrame:
    """Net change of the total per year with the label of the relative change.  N20, N77"""
    rows = year_window(_all_sectors(prj, by_mode))
    return net_and_relative(rows, ["year"], ["sector", "Units"], family).withColumn(
        "label", percent_label("annual_change")
    )


def _with_decile(df: DataFrame) -> DataFrame:
    label, decile = split_decile("sector")
    return df.withColumn("decile", decile).withColumn("sector", label)


DECILE_KEYS = ["scenario", "region", "sector", "decile", "year", "Units"]


REGION_KEYS = ["scenario", "region", "sector", "year", "Units"]


def _tagged(prj: Project, query: str, wanted: str, decile: str | None, source: str) -> DataFrame:
    """Rows of a table whose raw label is wanted, beside a tag; a decile is tested on the raw label, before anything is split."""
    rows = prj.query(query, "sector", "region").where(contains("sector", wanted))
    if decile is not None:
        rows = rows.where(F.col("sector").endswith(f"_{decile}"))
    return rows.select(*REGION_KEYS, "value", F.lit(source).alias("source"))


def _label_sums(*tables: DataFrame) -> DataFrame:
    """Sums of tagged tables by raw label, all in one exchange, then the decile split off and the label rewritten."""
    split = _with_decile(sum_by(union_all(*tables), ["source", *REGION_KEYS]))
    named = F.when(F.col("source") == "buildings", recode_first("sector", C.BUILDING_SECTORS[1:])).otherwise(
        recode_first("sector", C.PASSENGER_SECTORS)
    )
    return split.withColumn("sector", named).select(*DECILE_KEYS, "value")


def _residential(prj: Project, decile: str | None = None) -> DataFrame:
    return _tagged(prj, BUILDINGS, "resid", decile, "buildings")


def _passenger(prj: Project, wanted: str = "trn_pass|trn_aviation", decile: str | None = None) -> DataFrame:
    return _tagged(prj, TRANSPORT, wanted, decile, "transport")


def _decile_rows(prj: Project, decile: str | None = None) -> DataFrame:
    """Residential and passenger energy by decile; `decile` picks one by its label ending."""
    return _label_sums(_residential(prj, decile), _passenger(prj, decile=decile))


def buildings_by_decile(prj: Project) -> DataFrame:
    """Residential energy by region and decile.  N21"""
    return sum_by(_label_sums(_residential(prj)), DECILE_KEYS)


def transport_by_decile(prj: Project) -> DataFrame:
    """Passenger energy by region and decile.  N22"""
    return sum_by(_label_sums(_passenger(prj)), DECILE_KEYS)


def population_aggregate(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Persons per aggregate region.  N23"""
    people = (
        prj.query(POPULATION, "region")
        .withColumn("value", F.col("value") * C.THOUSAND_PERSONS)
        .withColumn("scenario", family.canonical())
    )
    return to_aggregate_region(people, regions, ["scenario", "region", "year"]).withColumnRenamed("value", "pop")


def _short_sector(sector: Column | str = "sector") -> Column:
    """Sector name as printed.

    The brackets of the last pattern are a group, so ` (pass)` with brackets
    stays in the name; the printed levels rely on that.
    """
    out = F.replace(sector, F.lit("Residential"), F.lit("Resid"))
    out = F.replace(out, F.lit(" services"), F.lit(""))
    out = F.replace(out, F.lit("International"), F.lit("Int."))
    return F.regexp_replace(out, " (pass)", "")


def decile_energy_change(
    prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY
) -> DataFrame:
    """Change of energy by decile and aggregate region, also per person.  N24

    The divisor is the whole population of the region.
    """
    changed = compare(year_window(_decile_rows(prj)), ["year", "region", "decile", "sector", "Units"], family)
    rolled = to_aggregate_region(changed, regions, ["scenario", "region", "year", "decile", "sector"])
    return (
        strict_lookup(
            rolled.withColumn("sector", _short_sector()),
            population_aggregate(prj, regions, family),
            ["scenario", "region", "year"], unique=True,
        )
        .withColumn("region", display_region())
        .withColumn("value_pc", safe_div(F.col("value") * C.EJ_TO_GJ, "pop"))
    )


def decile_energy_chart(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of energy by decile in the last year, with the drawing order of the deciles.  N24"""
    rows = decile_energy_change(prj, regions, family).where(F.col("year") == C.LAST_YEAR)
    return rows.withColumn("decile", F.upper("decile")).withColumn("decile_level", ordinal("decile", C.DECILE_LEVELS))


def population_by_decile(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Persons per region, split equally over the deciles.  N25"""
    people = (
        prj.query(POPULATION, "region")
        .withColumn("value", F.col("value") * C.THOUSAND_PERSONS)
        .withColumn("scenario", family.canonical())
        .drop("Units")
    )
    return split_equally(people, income_deciles(prj), "value").withColumnRenamed("value", "pop")


def income_growth_poorest(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Income of the lowest decile, 2050 over 2020.  N26"""
    rows = (
        prj.query(INCOME_QUERY, "consumer", "region")
        .where(contains("consumer", "resid") & contains("consumer", "d1") & F.col("year").isin(2020, 2050))
        .withColumn("decile", alnum_piece("consumer", 2))
        .where(F.col("decile") == "d1")
        .withColumn("scenario", family.canonical())
    )
    wide = pivot_cells(rows, ["scenario", "region", "decile"], "year", {"y2020": 2020, "y2050": 2050})
    return wide.select(
        "scenario", "region", "decile", safe_div("y2050", "y2020").alias("gdp_pc_change")
    )


def poorest_energy_growth(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Energy per person of the lowest decile, 2050 over 2020, beside income growth.  N27"""
    rows = sum_by(
        _decile_rows(prj, "d1").where(F.col("year").isin(2020, 2050))
        .withColumn("scenario", family.canonical()),
        DECILE_KEYS,
    )
    people = population_by_decile(prj, family)
    per_person = strict_lookup(rows, people, ["scenario", "region", "decile", "year"]).withColumn(
        "value_pc", safe_div(F.col("value") * C.EJ_TO_GJ, "pop")
    )
    wide = pivot_sums(
        per_person, ["scenario", "region", "sector", "decile", "Units"],
        "year", {"y2020": 2020, "y2050": 2050}, "value_pc",
    ).withColumn("change", safe_div("y2050", "y2020"))
    return strict_lookup(
        wide, income_growth_poorest(prj, family), ["scenario", "region", "decile"], unique=True
    )


def energy_per_person(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Energy per person by decile, each decile a tenth of the population.  N28"""
    rows = _decile_rows(prj).withColumn("scenario", family.canonical())
    rolled = to_aggregate_region(year_window(rows), regions, ["scenario", "region", "year", "decile"])
    return (
        strict_lookup(
            rolled, population_aggregate(prj, regions, family), ["scenario", "region", "year"], unique=True
        )
        .withColumn("region", display_region())
        .withColumn("value_pc", safe_div(F.col("value") * C.EJ_TO_GJ, F.col("pop") * 0.1))
    )


def energy_need_chart(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Energy per person of the poorest decile in the last year beside the energy that a decent life needs.  N28"""
    rows = energy_per_person(prj, regions, family).where((F.col("year") == C.LAST_YEAR) & (F.col("decile") == "d1"))
    return rows.withColumn("need", F.lit(float(C.ENERGY_NEED_GJ)))


def aviation_change(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of aviation energy by decile and aggregate region.  N29"""
    rows = year_window(_label_sums(_passenger(prj, "trn_aviation")))
    changed = compare(rows, ["year", "region", "decile", "sector", "Units"], family)
    return to_aggregate_region(
        changed, regions, ["scenario", "region", "year", "decile", "sector"]
    ).withColumn("region", F.translate("region", "_", " "))


def _fuel_change(rows: DataFrame, regions: DataFrame, family: ScenarioFamily) -> DataFrame:
    changed = compare(year_window(rows), ["year", "region", "fuel", "Units"], family, cells="single")
    return to_aggregate_region(changed, regions, ["scenario", "region", "fuel", "year", "Units"])


def primary_energy_change(
    prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY, with_population: bool = True
) -> DataFrame:
    """Change of primary energy by fuel.  N30, N78 (without population)"""
    rows = prj.query(PRIMARY, "fuel", "region").where(F.col("fuel") != "regional biomass")
    changed = _fuel_change(rows, regions, family)
    if not with_population:
        return changed
    return strict_lookup(
        changed, population_aggregate(prj, regions, family), ["scenario", "region", "year"], unique=True
    )


def ccs_change(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of fuels with carbon capture.  N31"""
    rows = prj.query(PRIMARY, "fuel", "region").where(contains("fuel", "CCS"))
    return _fuel_change(rows, regions, family)


def _wide_change(rows: DataFrame, ids, family: ScenarioFamily) -> DataFrame:
    wide = spread(rows, ids, family)
    return wide.select(
        *ids,
        *[change("abs", F.col(v), F.col(family.baseline)).alias(f"diff_{v}") for v in family.variants],
    )


def clean_energy_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of non-fossil and captured fuels in 2050, world.  N32"""
    captured = prj.query(PRIMARY, "fuel").where(contains("fuel", "CCS"))
    non_fossil = prj.query(PRIMARY_AVERAGE, "fuel").where(~contains("fuel", "coal|oil|gas"))
    rows = union_all(non_fossil, captured).where(F.col("year") == C.LAST_YEAR)
    return _wide_change(rows, ["year", "fuel", "Units"], family)


def managed_forest_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of managed forest area in 2050, world.  N33"""
    rows = prj.query(LAND, "landleaf").where(
        contains("landleaf", "Forest") & ~contains("landleaf", "Unmanaged")
        & (F.col("year") == C.LAST_YEAR)
    )
    return _wide_change(rows, ["year", "Units"], family)


