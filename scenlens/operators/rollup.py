"""Roll-ups and group totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens.functions import safe_div, strict_sum
from scenlens.operators.joins import lookup, strict_lookup


def to_aggregate_region(
    df: DataFrame, regions: DataFrame, keys: Sequence[str], value: str = "value"
) -> DataFrame:
    """Strict sum by `keys` with `region` replaced by its aggregate region."""
    named = strict_lookup(df, regions, ["region"])
    by = [F.col("region_agg").alias("region") if k == "region" else F.col(k) for k in keys]
    return named.groupBy(*by).agg(strict_sum(value).alias(value))


def with_group_total(
    df: DataFrame, group: Sequence[str], value: str = "value", out: str = "value_total"
) -> DataFrame:
    """Strict total of the group on every row.

    Totals are aggregated first (map-side) and joined back, so a group with a
    large part of all rows is never gathered in one task as a window would do.
    """
    totals = df.groupBy(*group).agg(strict_sum(value).alias(out))
    return lookup(df, totals, group)


def share_of_group(
    df: DataFrame, group: Sequence[str], value: str = "value", out: str = "share"
) -> DataFrame:
    """Part of every row in the total of its group."""
    return with_group_total(df, group, value, "__total").withColumn(
        out, safe_div(F.col(value), F.col("__total"))
    ).drop("__total")
