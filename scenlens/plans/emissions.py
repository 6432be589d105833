"""Greenhouse gases and pollutants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import contains, recode_first, separator_piece, sum0
from scenlens.operators import change, compare, spread, sum_by, union_all, year_window
from scenlens.scenarios import (
    ANY_POLICY,
    NO_POLICY,
    POLICY,
    REGIONAL_GHG,
    ScenarioFamily,
)
from scenlens.sources import Project

CO2_SECTOR = "CO2 emissions by sector (no bio) (excluding resource production)"
CO2_REGION = "CO2 emissions by region"
LAND_USE = "LUC emissions by region"
NON_CO2 = "nonCO2 emissions by region"

GAS_COLUMNS = ["scenario", "region", "year", "ghg", "value"]


def co2_equivalent(gases: DataFrame, gwp: DataFrame, keys, group: Column | None = None) -> DataFrame:
    """Emissions weighted by warming potential and added up.

    A gas without a potential adds nothing; its group stays in the result.
    Each gas is summed before it is weighted, so the lookup and the optional
    `group` label see one row per gas and key.  Missing values add nothing at
    either step.
    """
    summed = gases.groupBy(*keys, "ghg").agg(F.sum("value").alias("value"))
    by = list(keys)
    if group is not None:
        summed = summed.withColumn("group", group)
        by.append("group")
    return (
        summed.join(gwp, "ghg", "left")
        .groupBy(*by, F.lit("MtCO2e").alias("Units"))
        .agg(sum0(F.col("value") * F.col("gwp")).alias("value"))
    )


def _as_gas(df: DataFrame, gas: str) -> DataFrame:
    return df.withColumn("ghg", F.lit(gas)).select(*GAS_COLUMNS)


def _regional_sum(df: DataFrame) -> DataFrame:
    return sum_by(df, ["scenario", "region", "year"])


def world_ghg(prj: Project, gwp: DataFrame, family: ScenarioFamily = ANY_POLICY) -> DataFrame:
    """World total in GtCO2e.  N67

    Land-use emissions count only in years the energy CO2 table covers.
    """
    in_years = F.col("year").between(C.FIRST_YEAR, C.LAST_YEAR)
    # sums first: what is joined on a few years are totals, not the tables' rows
    co2 = _regional_sum(prj.query(CO2_SECTOR, "region").where(in_years))
    luc = _regional_sum(prj.query(LAND_USE, "region").where(in_years)).join(
        co2.select("year").distinct(), "year", "left_semi"
    )
    gases = union_all(
        prj.query(NON_CO2, "ghg", "region").where(in_years).select(*GAS_COLUMNS),
        _as_gas(luc, "CO2LUC"),
        _as_gas(co2, "CO2"),
    )
    return co2_equivalent(gases, gwp, ["scenario", "year"]).select(
        family.canonical().alias("scenario"), "year",
        (F.col("value") / C.MT_PER_GT).alias("value"), F.lit("GtCO2e").alias("Units"),
    )


def pollutants(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """World emissions of nine pollutants, agricultural parts included.  N72"""
    gas = separator_piece("ghg", "_", 1)
    raw = prj.query(NON_CO2, "ghg").where(F.col("year").between(C.FIRST_YEAR, C.LAST_YEAR))
    rows = (
        sum_by(raw, ["scenario", "ghg", "year", "Units"])
        .withColumn("scenario", family.canonical())
        .withColumn("ghg", F.when(contains(gas, "HFC"), "HFC").otherwise(gas))
        .where(F.col("ghg").isin(*C.POLLUTANTS))
    )
    return sum_by(rows, ["scenario", "ghg", "year", "Units"])


def _regional_gases(prj: Project) -> DataFrame:
    return year_window(union_all(
        prj.query(NON_CO2, "ghg", "region").select(*GAS_COLUMNS),
        _as_gas(prj.query(LAND_USE, "region"), "CO2LUC"),
        _as_gas(prj.query(CO2_REGION, "region"), "CO2"),
    ))


def regional_ghg(prj: Project, gwp: DataFrame, family: ScenarioFamily = REGIONAL_GHG) -> DataFrame:
    """Total per region in MtCO2e.  N73"""
    return co2_equivalent(_regional_gases(prj), gwp, ["scenario", "region", "year"]).withColumn(
        "scenario", family.canonical()
    )


def regional_ghg_relative(prj: Project, gwp: DataFrame, family: ScenarioFamily = REGIONAL_GHG) -> DataFrame:
    """Regional totals side by side with their relative change.  N74"""
    wide = spread(regional_ghg(prj, gwp, family), ["region", "year", "Units"], family, cells="single")
    base = F.col(family.baseline)
    return wide.select(
        "region", "year", "Units", *family.names,
        *[change("fraction", F.col(v), base).alias(f"diff_{v}") for v in family.variants],
    )


def gas_group(gas: Column | str = "ghg", n2o_apart: bool = False) -> Column:
    """CO2, land-use CO2, CH4, and one group for everything else.

    Nitrous oxide falls into the last group, as in the study, unless set apart.
    """
    gas = F.col(gas) if isinstance(gas, str) else gas
    rules = [*C.GAS_GROUPS, *([("has", "N2O", "N2O")] if n2o_apart else [])]
    return recode_first(gas, rules, F.when(gas.isNotNull(), "F-gases"))


def regional_ghg_by_group(prj: Project, gwp: DataFrame, family: ScenarioFamily = REGIONAL_GHG) -> DataFrame:
    """Regional totals by group of gases.  N75"""
    total = co2_equivalent(_regional_gases(prj), gwp, ["scenario", "region", "year"], gas_group())
    return total.withColumn("scenario", family.canonical())


def world_co2(prj: Project, family: ScenarioFamily = NO_POLICY) -> DataFrame:
    """World CO2 of the runs without policy.  N81"""
    keys = ["scenario", "year", "Units"]
    raw = sum_by(year_window(prj.query(CO2_REGION)), keys)
    return sum_by(raw.withColumn("scenario", family.levels(family.canonical())), keys)


def value_span(df: DataFrame, value: str = "value") -> DataFrame:
    """Smallest and largest value, the axis range of a chart.  N81"""
    return df.agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))


def regional_co2_change(prj: Project, family: ScenarioFamily = NO_POLICY) -> DataFrame:
    """Regional change of CO2 in the runs without policy.  N82

    The region stays in the result, so each row says what it measures.
    """
    plain = ScenarioFamily(base=family.base, baseline=family.baseline, variants=family.variants)
    return compare(
        year_window(prj.query(CO2_REGION, "region")), ["region", "year", "Units"], plain, cells="single"
    )
