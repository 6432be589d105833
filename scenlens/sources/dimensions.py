"""Small tables that describe regions, gases, foods, markets and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenlens import constants as C
from scenlens.operators.joins import inline_table
from scenlens.sources.files import read_csv


def region_map(spark: SparkSession) -> DataFrame:
    """Model regions with the coarser region each reports into."""
    return inline_table(spark, C.REGIONS, "region_id int, region string, region_agg string", ["region"])


def gwp(spark: SparkSession) -> DataFrame:
    """Warming potential per gas."""
    return inline_table(spark, C.GWP, "ghg string, gwp double")


def food_groups(spark: SparkSession) -> DataFrame:
    return inline_table(spark, C.FOOD_GROUPS, "subsector string, food_group string")


def market_regions(spark: SparkSession) -> DataFrame:
    return inline_table(spark, C.MARKET_REGIONS, "region string, alias string")


def code_list(spark: SparkSession, path: str) -> DataFrame:
    """Country codes to model regions: `iso, country_name, legacy_region, region_id`."""
    return read_csv(
        spark, path, "iso string, country_name string, legacy_region string, region_id int",
        comment="#", positional=True,
    )


def with_code_list(df: DataFrame, codes: DataFrame, key: str = "iso") -> DataFrame:
    """Names for codes; a code the list lacks gets NULL."""
    return df.join(codes, key, "left")


def policy_targets(spark: SparkSession, path: str) -> DataFrame:
    """Long table of emission targets."""
    return read_csv(
        spark, path, "sce string, region string, year int, Units string, value double"
    )


def policy_caps(spark: SparkSession, path: str) -> DataFrame:
    """Caps nested per region in XML, one row per region and year; a region without caps has one row without year and cap."""
    schema = (
        "_name string, ghgpolicy struct<_name:string, market:string, "
        "constraint:array<struct<_VALUE:double,_year:int>>>"
    )
    regions = spark.read.format("xml").option("rowTag", "region").schema(schema).load(path)
    return (
        regions.select(
            F.col("_name").alias("region"),
            F.col("ghgpolicy.market").alias("market"),
            F.col("ghgpolicy._name").alias("policy"),
            F.explode_outer("ghgpolicy.constraint").alias("c"),
        )
        .select("region", "market", "policy", F.col("c._year").alias("year"), F.col("c._VALUE").alias("cap"))
    )
