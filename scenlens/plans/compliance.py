"""Emissions against policy targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import half_even, safe_div, strict_sum
from scenlens.operators import gap_to_target, spread, to_long, union_all, year_window
from scenlens.plans.emissions import co2_equivalent
from scenlens.scenarios import COMPLIANCE, POLICY, ScenarioFamily
from scenlens.sources import read_wide_years

SHEET_IDS = ["scenario", "region", "ghg", "unit"]


@dataclass(frozen=True)
class Sheets:
    """The four sheets of an emission workbook, one wide column per year.

    `co2`, `luc` and `non_co2` have `scenario, region, ghg, unit` and year
    columns; `target` is long: `region, year, value`.
    """

    co2: DataFrame
    luc: DataFrame
    non_co2: DataFrame
    target: DataFrame


def targets(sheets: Sheets) -> DataFrame:
    """Targets, rounded to two digits."""
    return sheets.target.select(
        "region", F.col("year").cast("int").alias("year"),
        half_even(F.col("value").try_cast("double"), 2).alias("ghg_target"),
    )


def _carbon(sheet: DataFrame, gas: str) -> DataFrame:
    long = year_window(read_wide_years(sheet, SHEET_IDS))
    summed = long.groupBy("unit", "scenario", "region", "year").agg(strict_sum("value").alias("value"))
    return summed.withColumn("ghg", F.lit(gas)).drop("unit")


def totals_and_target(sheets: Sheets, gwp: DataFrame, family: ScenarioFamily = COMPLIANCE) -> DataFrame:
    """MtCO2e per region and year, one column per scenario, beside the target.  N88"""
    other = year_window(read_wide_years(sheets.non_co2, SHEET_IDS)).drop("unit")
    gases = union_all(other, _carbon(sheets.luc, "CO2LUC"), _carbon(sheets.co2, "CO2"))
    total = co2_equivalent(gases, gwp, ["scenario", "region", "year"])
    wide = spread(total, ["region", "year", "Units"], family, cells="single", complete=False)
    return wide.join(targets(sheets), ["region", "year"], "left")


def violations(
    sheets: Sheets, gwp: DataFrame, family: ScenarioFamily = COMPLIANCE, *,
    tolerance: float = 0.02, round_before_test: bool = True,
) -> DataFrame:
    """Scenarios that miss a positive target by more than the tolerance.  N89

    The share is rounded to two digits before the test, so the effective limit
    lies half a point higher; `round_before_test=False` tests the exact share.
    """
    ids = ["region", "year", "Units", "ghg_target"]
    checked = totals_and_target(sheets, gwp, family).where(~F.col("region").isin(*C.COMPLIANCE_EXCLUDED))
    names = {"PCA": family.baseline, **{v: v for v in family.variants}}
    missed = gap_to_target(checked, "ghg_target", names, ids, "diff_target_sce").where(
        (F.col("diff_target_sce") < 0) & (F.col("ghg_target") > 0)
    )
    gap = half_even("diff_target_sce", 2)
    part = safe_div(gap, "ghg_target")
    shown = half_even(part, 2)
    return (
        missed.withColumn("diff_target_sce_perc", shown)
        .where(F.abs(shown if round_before_test else part) > tolerance)
        .withColumn("diff_target_sce", gap)
    )


def target_chart(sheets: Sheets, gwp: DataFrame, family: ScenarioFamily = POLICY) -> DataFrame:
    """GtCO2e of the variants and the target in the last year.  N90"""
    any_policy = ScenarioFamily(base="RegGHGPol", baseline=family.baseline, variants=family.variants)
    wide = totals_and_target(sheets, gwp, any_policy).where(
        ~F.col("region").isin(*C.COMPLIANCE_EXCLUDED) & (F.col("year") == C.LAST_YEAR)
    )
    ids = ["region", "year"]
    shown = wide.select(*ids, *family.variants, F.col("ghg_target").alias("Target"))
    return to_long(shown, ids, [*family.variants, "Target"], "scenario", "GHG").select(
        F.translate("region", "_", " ").alias("region"), "year", F.lit("GtCO2e").alias("Units"),
        "scenario", (F.col("GHG") / C.MT_PER_GT).alias("GHG"),
    )
