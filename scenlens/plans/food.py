"""Food demand: world totals, regions, deciles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import (
    alnum_piece,
    ordinal,
    patch,
    recode_last,
    safe_div,
    strict_sum,
    strict_sum_where,
)
from scenlens.operators import (
    compare,
    kmeans_class,
    lookup,
    net_and_relative,
    pretty_class,
    strict_lookup,
    sum_by,
    to_aggregate_region,
    union_all,
    year_window,
)
from scenlens.operators.reshape import checked
from scenlens.plans.energy import display_region, percent_label, population_by_decile
from scenlens.scenarios import POLICY, ScenarioFamily
from scenlens.sources import Project

FOOD_TYPES = "food consumption by type (specific)"
FOOD_DEMAND = "food demand"


def staple_flag(commodity: Column | str) -> Column:
    """`Staples` or `Non-staples`; a missing name counts as the latter."""
    commodity = F.col(commodity) if isinstance(commodity, str) else commodity
    return F.when(commodity.isin(*C.STAPLES), "Staples").otherwise("Non-staples")


def _commodities(prj: Project) -> DataFrame:
    """World sums by commodity."""
    rows = prj.query(FOOD_TYPES, "technology").withColumnRenamed("technology", "subsector")
    return sum_by(rows, ["scenario", "subsector", "year", "Units"])


def commodity_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of world consumption by commodity, with its staple flag.  N34, N79"""
    rows = year_window(_commodities(prj))
    return compare(rows, ["year", "subsector", "Units"], family).withColumn("sector", staple_flag("subsector"))


def staple_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Commodity changes added up by staple flag.  N35, N79"""
    return (
        commodity_change(prj, family)
        .groupBy("scenario", "sector", "year", "Units").agg(strict_sum("value").alias("value"))
    )


def commodity_levels(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """World consumption by commodity in the level years.  N36"""
    return (
        _commodities(prj).where(F.col("year").isin(*C.LEVEL_YEARS))
        .withColumn("scenario", family.canonical())
        .groupBy("scenario", "subsector", "year", "Units").agg(strict_sum("value").alias("value"))
    )


def _read_labels(df: DataFrame) -> DataFrame:
    """Decile and demand class out of the consumer and input labels."""
    return (
        df.withColumn("decile", F.replace(alnum_piece("consumer", 2), F.lit("Group"), F.lit("d")))
        .withColumn("demand", alnum_piece("input", 2))
        .drop("consumer", "input")
    )


def food_rows(prj: Project) -> DataFrame:
    """Food demand, one row per cell of the table, with its labels read."""
    rows = prj.query(FOOD_DEMAND, "consumer", "input", "region")
    return _read_labels(rows).select("scenario", "region", "year", "decile", "demand", "value", "Units")


def food_sums(prj: Project, *keys: str) -> DataFrame:
    """Food demand summed by `keys` and the raw labels, which are read after that."""
    rows = prj.query(FOOD_DEMAND, "consumer", "input", "region")
    return _read_labels(sum_by(rows, ["scenario", "year", "consumer", "input", *keys]))


def food_relative(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Relative change of world demand by class, with its label.  N37"""
    return (
        compare(year_window(food_sums(prj)), ["year", "demand"], family, "percent", out="annual_change", cells="merged")
        .withColumn("label", percent_label("annual_change"))
        .withColumn("demand", F.replace("demand", F.lit("NonStaples"), F.lit("Non-staples")))
    )


def _totals(prj: Project, family: ScenarioFamily) -> DataFrame:
    return (
        commodity_change(prj, family)
        .groupBy("scenario", "year", "sector").agg(strict_sum("value").alias("total_value"))
    )


def _labelled(totals: DataFrame) -> DataFrame:
    return totals.na.drop("any").withColumn("sector_level", ordinal("sector", C.STAPLE_LEVELS))


def food_labelled(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Total change by staple flag joined with its label, complete rows only.  N38"""
    labels = food_relative(prj, family).withColumnRenamed("demand", "sector")
    return _labelled(lookup(_totals(prj, family), labels, ["year", "scenario", "sector"]))


def food_group_change(prj: Project, groups: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Commodity changes added up by food group.  N39"""
    return (
        commodity_change(prj, family).join(groups, "subsector", "left")
        .groupBy("scenario", "year", "sector", "food_group").agg(strict_sum("value").alias("value"))
    )


def food_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of demand by region, decile and class.  N40"""
    return compare(
        year_window(food_rows(prj)), ["year", "region", "demand", "decile", "Units"], family, cells="single"
    )


def food_map(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Regional change of demand with known artefacts overwritten, and its class in the map year.  N41

    Runs the jobs of `kmeans_class`.
    """
    rows = (
        food_change(prj, family)
        .groupBy(F.col("scenario").alias("sce"), F.col("region").alias("subRegion"), "year", "demand", "Units")
        .agg(strict_sum("value").alias("value"))
        .withColumn("value", patch("value", C.FOOD_PATCHES))
    )
    return kmeans_class(rows, value="value", among=F.col("year") == C.LAST_YEAR)


def food_percent(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Regional relative change of demand, artefacts overwritten, and its class in the map year.  N42"""
    rows = (
        compare(year_window(food_sums(prj, "region", "Units")), ["year", "region", "demand", "Units"], family, "percent")
        .select(
            F.col("scenario").alias("sce"), F.col("region").alias("subRegion"),
            "year", "demand", "value", F.lit("%").alias("Units"),
        )
        .withColumn("value", patch("value", C.FOOD_PATCHES))
    )
    return pretty_class(rows, among=F.col("year") == C.LAST_YEAR)


def food_subsector_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Regional change of consumption by broad food group.  N43

    The table names its subsector twice: `subsector_3` is the fine name,
    `subsector_4` the text the group rules look at.
    """
    raw = sum_by(
        year_window(prj.query(FOOD_TYPES, "subsector_3", "subsector_4", "region")),
        ["scenario", "region", "year", "Units", "subsector_3", "subsector_4"],
    )
    rows = raw.withColumn("subsector", recode_last("subsector_4", C.SUBSECTOR_GROUPS, F.col("subsector_3")))
    return compare(rows, ["year", "region", "subsector", "Units"], family)


def food_subsector_map(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Map form of the broad food groups, with the class of the change in the map year.  N43

    Runs the jobs of `kmeans_class`.
    """
    rows = food_subsector_change(prj, family).withColumnsRenamed({"scenario": "sce", "region": "subRegion"})
    return kmeans_class(rows, among=F.col("year") == C.LAST_YEAR)


def population_decile_aggregate(
    prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY
) -> DataFrame:
    """Persons per aggregate region and decile.  N44"""
    people = population_by_decile(prj, family).withColumnRenamed("pop", "value")
    return to_aggregate_region(
        people, regions, ["scenario", "region", "decile", "year"]
    ).withColumnRenamed("value", "pop")


def _kcal_per_day(rows: DataFrame, people: DataFrame) -> DataFrame:
    return strict_lookup(
        rows, people, ["year", "region", "decile", "scenario"], unique=True
    ).withColumn(
        "value", safe_div(F.col("value") * C.PCAL_TO_KCAL, "pop") / C.DAYS_PER_YEAR
    ).withColumn("Units", F.lit("kcal/day"))


def intake_change(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of daily calories per person by decile and class.  N45"""
    rows = year_window(food_sums(prj, "region", "Units")).withColumn("scenario", family.canonical())
    rolled = to_aggregate_region(rows, regions, ["scenario", "region", "decile", "demand", "year", "Units"])
    eaten = _kcal_per_day(rolled, population_decile_aggregate(prj, regions, family))
    return compare(
        eaten, ["year", "region", "demand", "decile", "Units"], family, cells="single"
    ).withColumn("region", display_region())


def intake_rows(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Daily calories per person by decile, with the population, by raw region name."""
    rows = year_window(food_sums(prj, "region", "Units")).withColumn("scenario", family.canonical())
    rolled = to_aggregate_region(rows, regions, ["scenario", "region", "decile", "year", "Units"])
    return _kcal_per_day(rolled, population_decile_aggregate(prj, regions, family))


def intake_and_people(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Persons of every decile beside their daily calories per person, by raw region name.

    Food and persons are tagged, stacked and rolled up in one exchange, so the persons are read once.  A decile
    without food keeps its row, without a value; food without persons, or in several units, fails the job.
    """
    keys = ["scenario", "region", "decile", "year"]
    food = year_window(food_sums(prj, "region", "Units")).withColumn("scenario", family.canonical())
    people = year_window(population_by_decile(prj, family)).withColumnRenamed("pop", "value")
    both = union_all(
        food.select(*keys, "Units", "value", F.lit(True).alias("food")),
        people.select(*keys, "value", F.lit(False).alias("food")),
    )
    named = strict_lookup(both, regions, ["region"])
    rolled = named.groupBy("scenario", F.col("region_agg").alias("region"), "decile", "year").agg(
        strict_sum_where(F.col("food"), "value").alias("eaten"), strict_sum_where(~F.col("food"), "value").alias("pop"),
        F.count_if(~F.col("food")).alias("people"), F.min("Units").alias("unit"), F.max("Units").alias("other"),
    )

    def fail(what: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{what} at "), F.to_json(F.struct(*keys)))).cast("boolean")

    sound = F.when(F.col("people") == 0, fail("food without persons")).when(
        F.col("unit") != F.col("other"), fail("food in several units")
    ).otherwise(F.lit(True))
    return rolled.where(checked(sound)).select(
        *keys, "pop", (safe_div(F.col("eaten") * C.PCAL_TO_KCAL, "pop") / C.DAYS_PER_YEAR).alias("value")
    )


def intake_level(prj: Project, regions: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """Daily calories per person by decile, with the population.  N53"""
    return intake_rows(prj, regions, family).withColumn("region", display_region())


def staple_relative(prj: Project, family: ScenarioFamily) -> DataFrame:
    """Relative change of world consumption by staple flag.  N80"""
    rows = year_window(_commodities(prj)).withColumn("sector", staple_flag("subsector"))
    return compare(
        rows, ["year", "sector", "Units"], family, "percent", out="annual_change"
    ).drop("Units").withColumn("label", percent_label("annual_change"))


def staple_labelled(prj: Project, family: ScenarioFamily) -> DataFrame:
    """Total change by staple flag joined with its label, complete rows only.  N80"""
    rows = year_window(_commodities(prj)).withColumn("sector", staple_flag("subsector"))
    totals = net_and_relative(rows, ["year", "sector"], ["subsector", "Units"], family)
    return _labelled(totals.withColumn("label", percent_label("annual_change")))
