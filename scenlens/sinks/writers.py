"""Result tables for files, reports, charts and maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens.functions import half_even, number_text, ordinal


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, for results of any size; rows of a partition are brought together first, large ones in several files."""
    df = df.hint("rebalance", *partition_by) if partition_by else df
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, gaps written as `NA`.

    `one_file` funnels the result through one task; keep it for report tables
    whose size is fixed by their keys (regions by scenarios).
    """
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def report_table(
    df: DataFrame, rounded: Mapping[str, int], percent: Mapping[str, int]
) -> DataFrame:
    """Presentation form: rounded numbers and `12.3%` texts."""
    return df.select(*[
        half_even(c, rounded[c]).alias(c) if c in rounded
        else F.concat(number_text(c, percent[c]), F.lit("%")).alias(c) if c in percent
        else F.col(f"`{c}`")
        for c in df.columns
    ])


def chart_table(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds `<column>_level`, the drawing order of each ordered category."""
    for column, names in levels.items():
        df = df.withColumn(f"{column}_level", ordinal(column, names))
    return df


def map_table(df: DataFrame, region: str, value: str, **facets: str) -> DataFrame:
    """Renames to what a map reads: `subRegion`, `value` and facets such as `row`, `col`, `class`."""
    names = {region: "subRegion", value: "value", **{column: facet for facet, column in facets.items()}}
    return df.withColumnsRenamed(names)
