"""Inequality of demand between income deciles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import (
    contains,
    ordinal,
    recode_first,
    safe_div,
    separator_piece,
    split_decile,
)
from scenlens.operators import (
    decile_gini,
    decile_shares,
    palma,
    pivot_cells,
    sum_by,
    union_all,
)
from scenlens.plans.energy import BUILDINGS
from scenlens.plans.food import FOOD_DEMAND
from scenlens.scenarios import POLICY_EXACT, POLICY_RUNS, ScenarioFamily
from scenlens.sources import Project

SERVICE = "transport service output by tech"
GROUP = ["scenario", "region", "sector", "year"]


def _runs(df: DataFrame, wanted: Column, labels, family: ScenarioFamily) -> DataFrame:
    """Rows of the policy runs summed by region, year and raw labels."""
    kept = df.where(F.col("scenario").isin(*POLICY_RUNS) & wanted)
    summed = sum_by(kept, ["scenario", "region", "year", *labels])
    return summed.withColumn("scenario", family.canonical())


def household_rows(prj: Project, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    """Modern residential energy by decile."""
    rows = _runs(prj.query(BUILDINGS, "sector", "region"), contains("sector", "modern"), ["sector"], family)
    return rows.select(
        "scenario", "region", "year", "value",
        separator_piece("sector", "_", 2).alias("decile"),
        recode_first(separator_piece("sector", "_", 1), C.MODERN_ENERGY_CLASSES).alias("sector"),
    )


def transport_rows(prj: Project, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    """Passenger transport service by decile."""
    rows = _runs(prj.query(SERVICE, "sector", "region"), contains("sector", "trn_pass_d|aviat"), ["sector"], family)
    label, decile = split_decile("sector")
    return rows.select(
        "scenario", "region", "year", "value", decile.alias("decile"),
        F.when(contains(label, "aviation"), "International aviation")
        .otherwise("Domestic transportation").alias("sector"),
    )


def food_rows(prj: Project, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    """Non-staple food by decile."""
    table = prj.query(FOOD_DEMAND, "consumer", "input", "region")
    rows = _runs(table, contains("input", "NonStaples"), ["consumer"], family)
    return rows.select(
        "scenario", "region", "year", "value",
        F.replace(separator_piece("consumer", "_", 2), F.lit("Group"), F.lit("d")).alias("decile"),
        F.lit("Non-staple food").alias("sector"),
    )


def all_rows(prj: Project, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    return union_all(household_rows(prj, family), transport_rows(prj, family), food_rows(prj, family))


def household_palma(prj: Project) -> DataFrame:
    """Palma-type ratio of residential energy.  N55"""
    return palma(household_rows(prj), GROUP)


def transport_palma(prj: Project) -> DataFrame:
    """Palma-type ratio of passenger transport.  N56"""
    return palma(transport_rows(prj), GROUP)


def food_palma(prj: Project) -> DataFrame:
    """Palma-type ratio of non-staple food.  N57"""
    return palma(food_rows(prj), GROUP)


def _map_form(df: DataFrame, value: str) -> DataFrame:
    return (
        df.where(F.col("year").isin(*C.MAP_YEARS))
        .withColumnsRenamed({"region": "subRegion", value: "value", "sector": "class"})
        .withColumn("scenario_level", ordinal("scenario", POLICY_EXACT.names))
        .withColumn("class_level", ordinal("class", C.DEMAND_CLASSES))
    )


def demand_inequality(prj: Project) -> DataFrame:
    """Palma-type ratios of all demands in the map years.  N58"""
    return _map_form(palma(all_rows(prj), GROUP), "palma")


def demand_inequality_ratio(prj: Project, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    """Palma-type ratio of each variant over the baseline.  N59"""
    ids = ["subRegion", "class", "year"]
    wide = pivot_cells(demand_inequality(prj), ids, "scenario", family.names)
    return wide.select(
        *ids, *family.names,
        *[safe_div(v, family.baseline).alias(f"ratio_{v}") for v in family.variants],
    )


def demand_by_decile(prj: Project) -> DataFrame:
    """Demand per decile of all three kinds.  N60"""
    return sum_by(all_rows(prj), [*GROUP, "decile"])


def demand_shares(prj: Project) -> DataFrame:
    """Share of each decile in the regional demand.  N61"""
    return decile_shares(all_rows(prj).where(F.col("year") <= C.LAST_YEAR), GROUP)


def demand_gini(prj: Project) -> DataFrame:
    """Gini index of demand in the map years.  N62"""
    rows = all_rows(prj).where(F.col("year").isin(*C.MAP_YEARS))
    return _map_form(decile_gini(rows, GROUP), "gini")
