"""Cost of climate policy against economic output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import choose, patch, safe_div, strict_sum
from scenlens.operators import annual_series, compare, pretty_class, strict_lookup
from scenlens.scenarios import POLICY, ScenarioFamily
from scenlens.sources import Project

GDP = "GDP MER by region"
COST = "policy cost by period"
UNDISCOUNTED = "undiscounted policy cost"


def gdp(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Output per region and model year.  N68"""
    return prj.query(GDP, "region").withColumn("scenario", family.canonical())


def cumulative_gdp(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Output summed over all years of the policy period.  N68"""
    annual = annual_series(gdp(prj, family), ["scenario", "region"], *C.POLICY_COST_YEARS)
    return annual.groupBy("scenario", "region").agg(strict_sum("value").alias("undisc_gdp")).withColumn(
        "Units", F.lit("million 1990$")
    )


def cumulative_world_gdp(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """World form of the cumulative output.  N68"""
    return cumulative_gdp(prj, family).groupBy("scenario", "Units").agg(
        strict_sum("undisc_gdp").alias("undisc_gdp")
    )


def cost_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of the last year's cost, never negative, in percent of output.  N69"""
    rows = prj.query(COST, "region").where(F.col("year") == C.LAST_YEAR)
    changed = compare(rows, ["year", "region"], family, out="PolCost", cells="single").withColumn(
        "PolCost", choose(F.col("PolCost") < 0, 0.0, F.col("PolCost"))
    ).withColumn("unit_polcost", F.lit("Million$1990"))
    output = gdp(prj, family).where(F.col("year") == C.LAST_YEAR).select("scenario", "region", "year", "value")
    return strict_lookup(changed, output, ["scenario", "region", "year"]).withColumn(
        "PolCost_gdp", safe_div("PolCost", "value") * C.PERCENT
    )


def _undiscounted(prj: Project, family: ScenarioFamily) -> DataFrame:
    """Cost per region; the table names its region and cost columns alike."""
    return prj.query(UNDISCOUNTED, "undiscountedcost_3", "undiscountedcost_4").select(
        family.canonical().alias("scenario"),
        F.col("undiscountedcost_3").alias("region"),
        F.col("undiscountedcost_4").alias("PolCost"),
    ).distinct()


def undiscounted_cost_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of the whole period's cost in percent of output, per region.  N70"""
    cost = strict_lookup(
        _undiscounted(prj, family), cumulative_gdp(prj, family), ["scenario", "region"], unique=True
    ).withColumn("PolCost_gdp", safe_div("PolCost", "undisc_gdp") * C.PERCENT)
    changed = compare(cost, ["region"], family, value="PolCost_gdp", out="PolCost_chg_gdp", cells="single")
    raised = choose(F.col("PolCost_chg_gdp") < 0, 0.01, F.col("PolCost_chg_gdp"))
    return changed.withColumn("PolCost_chg_gdp", patch(raised, C.POLICY_COST_PATCHES))


def undiscounted_cost_map(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Map form of the regional change with round classes.  N70"""
    rows = undiscounted_cost_change(prj, family).withColumnsRenamed(
        {"PolCost_chg_gdp": "value", "region": "subRegion"}
    )
    return pretty_class(rows.withColumn("units", F.lit("%")))


def undiscounted_world_cost_change(prj: Project, family: ScenarioFamily = POLICY) -> DataFrame:
    """Change of the whole period's cost in percent of output, world.  N71"""
    cost = _undiscounted(prj, family).groupBy("scenario").agg(strict_sum("PolCost").alias("PolCost"))
    ratio = strict_lookup(
        cost, cumulative_world_gdp(prj, family).select("scenario", "undisc_gdp"), ["scenario"], unique=True
    ).withColumn("PolCost_gdp", safe_div("PolCost", "undisc_gdp") * C.PERCENT)
    return compare(ratio, [], family, value="PolCost_gdp", out="PolCost_chg_gdp", cells="single")
