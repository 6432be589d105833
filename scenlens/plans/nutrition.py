"""Dietary energy adequacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import not_in_nor_null, safe_div, strict_sum
from scenlens.operators import lookup, year_window
from scenlens.plans.energy import display_region
from scenlens.plans.food import intake_and_people
from scenlens.scenarios import POLICY, ScenarioFamily
from scenlens.sources import Project, read_csv, read_wide_years

# The run of the demographic file, and its totals over all ages.
DEMOGRAPHIC_RUN = "SSP2_v9_130115"
TOTAL_GROUPS = ("Population|Male", "Population|Female", "Population")


def calorie_needs(spark: SparkSession, path: str) -> DataFrame:
    """Daily need per sex and age group with its lower and upper bound.  N46"""
    needs = read_csv(
        spark, path,
        "variable string, mder_units string, mder double, std double, min double, max double",
        positional=True,
    )
    return needs.withColumn("mder_units", F.lit("kcal/capita/day"))


def region_of_country(regions: DataFrame, codes: DataFrame) -> DataFrame:
    """Country name, model region number and aggregate region.  N47

    A country listed under two codes of one region appears once.
    """
    return (
        regions.join(codes, "region_id", "left")
        .select("country_name", "region_id", F.col("region_agg").alias("region"))
        .distinct()
    )


def demographic_population(codes: DataFrame, demography: DataFrame) -> DataFrame:
    """Persons per country, sex and age group, long.  N48

    `demography`: `model, scenario, region, iso, variable, unit` and one column
    per year, in millions.  Countries without data keep one row without values.
    """
    run = demography.where(F.col("scenario") == DEMOGRAPHIC_RUN).drop("model", "region")
    wide = codes.select("iso", "country_name").join(run, "iso", "left")
    long = read_wide_years(wide, ["iso", "country_name", "scenario", "variable", "unit"])
    return long.withColumn("value", F.col("value") * C.MILLION_PERSONS).withColumn(
        "unit", F.lit("total population")
    )


def demographic_shares(population: DataFrame) -> DataFrame:
    """Each sex and age group as part of its country's population.  N49

    A country and year has as many rows as there are groups, so its total is read by a window: one shuffle.
    """
    total = F.max(F.when(F.col("variable") == "Population", F.col("value"))).over(Window.partitionBy("iso", "year"))
    groups = population.withColumn("total_pop", total).where(not_in_nor_null("variable", TOTAL_GROUPS))
    return groups.withColumn("demo_share", safe_div("value", "total_pop")).withColumnsRenamed(
        {"value": "sub_pop", "unit": "pop_units"}
    )


def regional_population(shares: DataFrame, countries: DataFrame) -> DataFrame:
    """Country populations beside the total of their aggregate region.  N50"""
    by_country = (
        shares.join(countries.select("country_name", "region"), "country_name", "left")
        .select("year", "country_name", "region", "total_pop").distinct()
    )
    totals = by_country.groupBy("year", "region").agg(strict_sum("total_pop").alias("total_regional_pop"))
    return lookup(by_country, totals, ["year", "region"])


def _placed(shares: DataFrame, countries: DataFrame) -> DataFrame:
    """Groups of countries in their aggregate regions; `persons` is missing where the country's total is."""
    known = F.col("total_pop").isNotNull() & (F.col("total_pop") != 0)
    return shares.join(countries.select("country_name", "region"), "country_name", "left").withColumn(
        "persons", F.when(known, F.col("sub_pop"))
    )


def regional_demography(shares: DataFrame, countries: DataFrame) -> DataFrame:
    """Part of each sex and age group in the population of an aggregate region.

    A country counts with its share of the region's population.  Countries are
    added up here, before scenarios and deciles multiply the rows, on which
    neither the shares nor the weights depend.
    """
    placed = _placed(shares, countries)
    groups = placed.groupBy("region", "year", "variable").agg(strict_sum("persons").alias("persons"))
    totals = (
        placed.select("year", "country_name", "region", "total_pop").distinct()
        .groupBy("region", "year").agg(strict_sum("total_pop").alias("total"))
    )
    return lookup(groups, totals, ["region", "year"]).select(
        "region", "year", "variable", safe_div("persons", "total").alias("part")
    )


def population_by_sex_age(shares: DataFrame, countries: DataFrame, people: DataFrame) -> DataFrame:
    """Persons by scenario, aggregate region, decile, sex and age group.  N51"""
    parts = regional_demography(shares, countries)
    return lookup(parts, people, ["region", "year"]).select(
        "scenario", "variable", "year", "region", "decile",
        (F.col("part") * F.col("pop")).alias("pop_sex_age"),
    )


def need_per_person(shares: DataFrame, countries: DataFrame, needs: DataFrame) -> DataFrame:
    """Mean daily need per aggregate region and year: central, low and high.

    The groups' needs and the countries' totals are added up country by country and then by region, in one chain.
    """
    bounds = ("mder", "min", "max")
    fed = year_window(_placed(shares, countries)).join(needs.select("variable", *bounds), "variable", "left")
    by_country = fed.groupBy("region", "year", "country_name", "total_pop").agg(
        *[strict_sum(F.col(c) * F.col("persons")).alias(c) for c in bounds]
    )
    return by_country.groupBy("region", "year").agg(
        *[safe_div(strict_sum(c), strict_sum("total_pop")).alias(c) for c in bounds]
    )


def calorie_requirement(
    shares: DataFrame, countries: DataFrame, needs: DataFrame, people: DataFrame
) -> DataFrame:
    """Total daily need per region and decile: central, low and high.  N52

    Sex and age groups are added up per person first, then multiplied by the
    persons of each scenario and decile.
    """
    return (
        lookup(need_per_person(shares, countries, needs), people, ["region", "year"])
        .select(
            "scenario", display_region().alias("region"), "year", "decile",
            (F.col("mder") * F.col("pop")).alias("denominator_sum"),
            (F.col("min") * F.col("pop")).alias("min_denominator_sum"),
            (F.col("max") * F.col("pop")).alias("max_denominator_sum"),
        )
    )


def adequacy(
    prj: Project, regions: DataFrame, shares: DataFrame, countries: DataFrame, needs: DataFrame,
    family: ScenarioFamily = POLICY,
) -> DataFrame:
    """Dietary energy supply in percent of the need; below 100 is too little.  N54"""
    need = need_per_person(shares, countries, needs)
    joined = lookup(need, intake_and_people(prj, regions, family), ["region", "year"])

    def index(total):
        return safe_div("value", F.col(total) * F.col("pop")) * F.col("pop") * C.PERCENT

    return joined.select(
        "year", display_region().alias("region"), "scenario", "decile",
        index("mder").alias("adesa"), index("min").alias("min_adesa"), index("max").alias("max_adesa"),
    )
