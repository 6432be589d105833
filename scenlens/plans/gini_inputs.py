"""Income distribution behind the scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.functions import contains, half_even, ordinal, recode_first
from scenlens.operators import (
    cross_with,
    fixed_class,
    pivot_cells,
    pretty_class,
    to_long,
    union_all,
    year_window,
)
from scenlens.scenarios import INCOME, POLICY, VARIANTS, ScenarioFamily
from scenlens.sources import read_wide_years, with_code_list

MODELS = POLICY.names


@dataclass(frozen=True)
class DecileFiles:
    """Income deciles: the multi-model file and one file per variant.

    Columns: `region_id, year, model, sce, category, shares, gini`.
    """

    base: DataFrame
    variants: tuple[DataFrame, ...]


def lowest_gini(history: DataFrame, countries: DataFrame) -> DataFrame:
    """Lowest Gini on record per country, with name and continent.  N01

    `history` may hold the Gini as text; a text that is no number drops the row.
    """
    return with_code_list(
        history.select(
            F.upper("iso").alias("iso"), F.col("GiniMinHist").try_cast("double").alias("gini_MinHist")
        ).na.drop("any"),
        countries,
    )


def country_gini(compared: DataFrame, countries: DataFrame, baseline_column: str) -> DataFrame:
    """Gini per country and scenario, long.  N02

    Columns whose name contains `scal` are left out, the observed Gini stays.
    """
    keep = [c for c in compared.columns if "scal" not in c.lower()]
    named = with_code_list(
        compared.select(*keep).withColumn("iso", F.upper("iso")), countries
    ).withColumnRenamed(baseline_column, "Baseline")
    return to_long(named, [c for c in named.columns if c not in MODELS], list(MODELS), "scenario", "gini")


def _stack(files: DecileFiles) -> DataFrame:
    base = files.base.where(F.col("model") == C.REFERENCE_MODEL).withColumn("model", F.lit(POLICY.baseline))
    return union_all(base, *files.variants)


def _named(df: DataFrame, regions: DataFrame) -> DataFrame:
    return df.join(regions.select("region_id", "region"), "region_id", "left")


def decile_income(files: DecileFiles, regions: DataFrame, keep=C.SHARE_REGIONS) -> DataFrame:
    """Income shares of the middle pathway for the selected regions.  N03"""
    rows = _named(_stack(files).where(F.col("sce") == "SSP2"), regions).na.drop("any")
    return rows.where(F.col("region").isin(*keep)) if keep else rows


def start_gini(files: DecileFiles, regions: DataFrame) -> DataFrame:
    """Gini of the first year per region.  N04"""
    return _named(files.base.where(F.col("year") == C.FIRST_YEAR), regions).select(
        "region", "year", "gini"
    ).distinct()


def _gini_change(rows: DataFrame, ids) -> DataFrame:
    """Rounded Gini change from the first to the last year; equal rows count once."""
    ends = rows.where(F.col("year").isin(C.FIRST_YEAR, C.LAST_YEAR)).distinct()
    wide = pivot_cells(ends, ids, "year", {"first": C.FIRST_YEAR, "last": C.LAST_YEAR}, "gini")
    return wide.select(*ids, half_even(F.col("last") - F.col("first"), 2).alias("value"))


def _paths(files, regions, keep) -> DataFrame:
    return decile_income(files, regions, keep).select(F.col("model").alias("scenario"), "region", "year", "gini")


def gini_table(files: DecileFiles, regions: DataFrame, keep=C.SHARE_REGIONS) -> DataFrame:
    """Gini change per region, one column per scenario.  N05"""
    rows = union_all(
        _paths(files, regions, keep), start_gini(files, regions).withColumn("scenario", F.lit("Baseline"))
    )
    wide = pivot_cells(_gini_change(rows, ["scenario", "region"]), ["region"], "scenario", MODELS)
    spaced = F.translate("region", "_", " ")
    return wide.withColumn("region", recode_first(spaced, [
        ("is", "Central America and Caribbean", "CAC"),
        ("is", "European Free Trade Association", "EFTA"),
    ]))


def gini_path(files: DecileFiles, regions: DataFrame, keep=C.SHARE_REGIONS) -> DataFrame:
    """Gini over time, every scenario starting from the observed year.  N06"""
    future = year_window(decile_income(files, regions, keep)).select("region", "year", "model", "gini")
    return union_all(future, cross_with(start_gini(files, regions), model=MODELS)).distinct()


def _from_common_start(files, regions, keep) -> DataFrame:
    future = _paths(files, regions, keep).where(F.col("year") > C.FIRST_YEAR)
    rows = union_all(future, cross_with(start_gini(files, regions), scenario=MODELS))
    return _gini_change(rows, ["scenario", "region"])


def gini_map(files: DecileFiles, regions: DataFrame, keep=C.SHARE_REGIONS) -> DataFrame:
    """Gini change for the map, with round classes.  N07"""
    changed = _from_common_start(files, regions, keep)
    wide = pivot_cells(changed, ["region"], "scenario", MODELS).withColumnRenamed("region", "subRegion")
    return pretty_class(to_long(wide, ["subRegion"], MODELS))


def income_map(poverty: DataFrame, family: ScenarioFamily = INCOME) -> DataFrame:
    """Income per person of three deciles in the last year, with fixed classes.  N08

    `poverty`: `sce, region, decile` and one column per year.
    """
    rows = poverty.where(~contains("sce", "MinHist")).select(
        family.canonical("sce").alias("sce"), F.col("region").alias("subRegion"),
        F.upper(F.replace("decile", F.lit("resid_"), F.lit(""))).alias("decile"),
        *[c for c in poverty.columns if c not in ("sce", "region", "decile")],
    ).where(F.col("decile").isin("D1", "D5", "D10"))
    long = read_wide_years(rows, ["sce", "subRegion", "decile"]).where(F.col("year") == C.LAST_YEAR)
    return fixed_class(
        long.withColumn("sce_level", ordinal("sce", family.names))
        .withColumn("decile_level", ordinal("decile", ("D1", "D5", "D10"))),
        C.INCOME_BREAKS,
    )


def variant_gini_change(files: DecileFiles, regions: DataFrame, keep=C.SHARE_REGIONS) -> DataFrame:
    """Gini change of the two variants, named like pathways.  N09"""
    return _from_common_start(files, regions, keep).where(F.col("scenario").isin(*VARIANTS)).select(
        F.col("region").alias("subRegion"), F.col("scenario").alias("ssp"), "value"
    )


def start_gini_all_pathways(files: DecileFiles, regions: DataFrame) -> DataFrame:
    """Observed Gini repeated for every scenario and pathway.  N10"""
    return cross_with(start_gini(files, regions), scenario=MODELS, sce=C.SSPS)


def pathway_gini_change(files: DecileFiles, regions: DataFrame, keep=C.SHARE_REGIONS) -> DataFrame:
    """Gini change of each pathway beside the variants, with round classes.  N11"""
    ends = _named(_stack(files), regions).na.drop("any").where(F.col("year") == C.LAST_YEAR).select(
        F.col("model").alias("scenario"), "sce", "region", "year", "gini"
    )
    rows = union_all(ends, start_gini_all_pathways(files, regions))
    pathways = _gini_change(rows, ["scenario", "sce", "region"]).where(
        F.col("scenario") == POLICY.baseline
    ).select(F.col("region").alias("subRegion"), F.col("sce").alias("ssp"), "value")
    both = union_all(pathways, variant_gini_change(files, regions, keep))
    return pretty_class(both.withColumn("ssp_level", ordinal("ssp", (*VARIANTS, *C.SSPS))))
