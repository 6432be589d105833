"""Many-scenario runs: energy and carbon price against inequality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import recode_first, strict_avg
from scenlens.operators import fit_line, strict_lookup, sum_by, union_all, year_window
from scenlens.plans.energy import BUILDINGS, INDUSTRY, TRANSPORT_TOTAL
from scenlens.plans.prices import PRICES
from scenlens.sources import Project

WORLD_MARKET = "globalCO2"


def regional_gini(deciles: DataFrame, regions: DataFrame) -> DataFrame:
    """Gini per model, pathway, region and year.  N83"""
    rows = year_window(deciles).where(F.col("model").isin(*[m for m, _ in C.SENSITIVITY_MODELS]))
    short = recode_first("model", [("is", m, s) for m, s in C.SENSITIVITY_MODELS])
    named = rows.select(
        "region_id", "year", F.concat(short, F.lit("_"), F.col("sce")).alias("scenario"), "gini"
    ).distinct()
    return strict_lookup(named, regions.select("region_id", "region"), ["region_id"])


def world_gini(deciles: DataFrame, regions: DataFrame) -> DataFrame:
    """Plain mean of the regional Ginis.  N83"""
    return regional_gini(deciles, regions).groupBy("scenario", "year").agg(strict_avg("gini").alias("gini"))


def regional_energy(prj: Project) -> DataFrame:
    """Total final energy per region: three tables stacked, one group-by.  N84"""
    keep = ["scenario", "region", "year", "Units", "value"]
    rows = union_all(*[prj.query(q, "region").select(*keep) for q in (BUILDINGS, INDUSTRY, TRANSPORT_TOTAL)])
    return sum_by(year_window(rows), keep[:-1])


def world_price(prj: Project) -> DataFrame:
    """Price of the world carbon market.  N85"""
    return year_window(prj.query(PRICES, "market").where(F.col("market") == WORLD_MARKET))


def energy_against_gini(prj: Project, deciles: DataFrame, regions: DataFrame) -> DataFrame:
    """Energy and Gini of each region and scenario.  N86"""
    energy = regional_energy(prj).withColumnRenamed("value", "tfe")
    return strict_lookup(regional_gini(deciles, regions), energy, ["year", "scenario", "region"])


def energy_gini_fit(prj: Project, deciles: DataFrame, regions: DataFrame) -> DataFrame:
    """Line of energy on Gini per region in the last year.  N86"""
    rows = energy_against_gini(prj, deciles, regions).where(
        (F.col("year") == C.LAST_YEAR) & F.col("region").isin(*C.FIT_REGIONS)
    )
    return fit_line(rows, ["region"], "tfe", "gini")


def price_against_gini(prj: Project, deciles: DataFrame, regions: DataFrame) -> DataFrame:
    """World carbon price and mean Gini of each scenario.  N87"""
    price = world_price(prj).select("scenario", "year", F.col("value").alias("cprice"))
    return strict_lookup(world_gini(deciles, regions), price, ["year", "scenario"])


def price_gini_fit(prj: Project, deciles: DataFrame, regions: DataFrame) -> DataFrame:
    """Line of carbon price on Gini per year.  N87"""
    rows = price_against_gini(prj, deciles, regions).where(F.col("year") != 2020)
    return fit_line(rows, ["year"], "cprice", "gini")
