"""Carbon prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import absent_as_zero, contains, half_even
from scenlens.operators import change, compare, pretty_class, spread
from scenlens.scenarios import POLICY_EXACT, ScenarioFamily
from scenlens.sinks import report_table
from scenlens.sources import Project

PRICES = "CO2 prices"


def deflator(index: DataFrame, to: int, base: int) -> Column:
    """Price level of year `to` over year `base` from a table `(year, index)`."""
    def level(year):
        return index.where(F.col("year") == year).select("index").scalar()

    return level(to) / level(base)


def carbon_prices(
    prj: Project, index: DataFrame, aliases: DataFrame, family: ScenarioFamily = POLICY_EXACT
) -> DataFrame:
    """Prices per region in 2015 money.  N63

    The market text is the region name followed by `CO2`; twelve short names
    are looked up, the rest is the region name itself.
    """
    rows = prj.query(PRICES, "market").where(
        ~contains("market", "FUG|LUC") & F.col("year").between(C.FIRST_YEAR, C.LAST_YEAR)
    )
    named = rows.withColumn("region", F.replace("market", F.lit("CO2"), F.lit(""))).drop("market")
    full = named.join(aliases, "region", "left").withColumn("region", F.coalesce("alias", "region")).drop("alias")
    tidy = F.replace("region", F.lit("Middle_East"), F.lit("Middle East"))
    return full.select(
        family.canonical().alias("scenario"),
        F.replace(tidy, F.lit("South_Africa"), F.lit("South Africa")).alias("region"),
        "year",
        (F.col("value") * deflator(index, 2015, 1990)).alias("value"),
        F.lit("2015$/tC").alias("Units"),
    )


def price_levels(prices: DataFrame, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    """Rounded prices and differences in the map years.  N64"""
    rows = prices.where(F.col("year").isin(*C.MAP_YEARS))
    wide = spread(rows, ["region", "year", "Units"], family, cells="single")
    base = F.col(family.baseline)
    return wide.select(
        "region", "year",
        *[half_even(n, 0).alias(n) for n in family.names],
        *[half_even(change("abs", F.col(v), base), 1).alias(f"Diff_{v}") for v in family.variants],
    )


def price_table(prices: DataFrame, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    """Report table of the last year with percent texts.  N65"""
    rows = prices.where(F.col("year") == C.LAST_YEAR)
    wide = spread(rows, ["region", "year", "Units"], family, cells="single")
    base = F.col(family.baseline)
    columns = {f"%Diff_{v}": change("percent", F.col(v), base) for v in family.variants}
    return report_table(
        wide.select("region", *family.names, *[c.alias(n) for n, c in columns.items()]),
        rounded={n: 0 for n in family.names},
        percent={n: 1 for n in columns},
    )


def price_change(prices: DataFrame, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    """Price differences, 0 where one side has no price.  N66"""
    return (
        compare(prices, ["region", "year", "Units"], family, out="diff", cells="single")
        .drop("Units")
        .withColumn("diff", absent_as_zero("diff"))
        .withColumn("units", F.lit("2015$"))
    )


def price_map(prices: DataFrame, family: ScenarioFamily = POLICY_EXACT) -> DataFrame:
    """Map form of the differences in the last year, with round classes.  N66"""
    rows = (
        price_change(prices, family).where(F.col("year") == C.LAST_YEAR)
        .withColumnsRenamed({"diff": "value", "region": "subRegion"})
        .withColumn("units", F.lit("2015$/tCO2-eq"))
    )
    return pretty_class(rows)
