"""Concentration of demand over income deciles.

The ten deciles are a closed list, so each measure is a handful of conditional
sums: one shuffle on the group, partially aggregated before it, and no window
or list whose size depends on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens.constants import DECILES
from scenlens.functions import safe_div, strict_sum_where


def _per_decile(df, group, decile, value, levels) -> DataFrame:
    """Group rows with `cells`, an array of (category, value) of the deciles present."""
    label = F.col(decile)
    stray = F.count_if(F.coalesce(~label.isin(list(levels)), F.lit(True)))
    cells = F.array(*[
        F.when(
            F.count_if(label == d) > 0,
            F.struct(F.lit(d).alias("category"), strict_sum_where(label == d, value).alias("v")),
        )
        for d in levels
    ])
    message = F.concat(F.lit("category outside the decile list in "), F.to_json(F.struct(*group)))
    return df.groupBy(*group).agg(
        F.when(stray > 0, F.raise_error(message).cast("array<struct<category:string,v:double>>"))
        .otherwise(F.filter(cells, lambda c: c.isNotNull()))
        .alias("cells")
    )


def _total(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c["v"])


def palma(
    df: DataFrame, group: Sequence[str], decile: str = "decile", value: str = "value", out: str = "palma"
) -> DataFrame:
    """Top decile over the four lowest; NULL when one of the five is missing."""
    wanted = {d: strict_sum_where(F.col(decile) == d, value) for d in ("d1", "d2", "d3", "d4", "d10")}
    return df.groupBy(*group).agg(*[c.alias(f"__{d}") for d, c in wanted.items()]).select(
        *group,
        safe_div(
            F.col("__d10"), F.col("__d1") + F.col("__d2") + F.col("__d3") + F.col("__d4")
        ).alias(out),
    )


def decile_shares(
    df: DataFrame, group: Sequence[str], decile: str = "decile", value: str = "value",
    levels: Sequence[str] = DECILES,
) -> DataFrame:
    """Share of each decile in its group and the sum of shares as a check."""
    summed = _per_decile(df, group, decile, value, levels)
    shared = summed.select(*group, F.transform(
        "cells",
        lambda c: F.struct(
            c["category"].alias("category"), safe_div(c["v"], _total(F.col("cells"))).alias("share")
        ),
    ).alias("cells"))
    check = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + c["share"])
    return shared.select(*group, check.alias("share_check"), F.inline("cells")).select(
        *group, "category", "share", "share_check"
    )


def decile_gini(
    df: DataFrame, group: Sequence[str], decile: str = "decile", value: str = "value",
    levels: Sequence[str] = DECILES, out: str = "gini",
) -> DataFrame:
    """Gini index of equally large groups.

    With n shares in rising order s(1) <= ... <= s(n):
    `1 - (1/n) * sum s(i) * (1 + 2 * (n - i))`.
    """
    summed = _per_decile(df, group, decile, value, levels)
    n = F.size("cells")
    whole = ~F.exists("cells", lambda c: c["v"].isNull())
    shares = F.array_sort(F.transform("cells", lambda c: safe_div(c["v"], _total(F.col("cells")))))
    weighted = F.transform(shares, lambda s, i: s * (1 + 2 * (n - 1 - i)))
    lorenz = F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)
    return summed.select(*group, F.when(whole, 1 - safe_div(lorenz, n.cast("double"))).alias(out))


def split_equally(
    df: DataFrame, categories: DataFrame, value: str, column: str = "decile",
    levels: Sequence[str] = DECILES,
) -> DataFrame:
    """Repeat each row per category, each copy with an equal part of the value.

    The categories that occur in `categories[column]` are found by counting
    each level, so the subquery returns one row of at most `len(levels)` names.
    """
    label = F.col(column)
    stray = F.count_if(F.coalesce(~label.isin(list(levels)), F.lit(True)))
    present = F.array(*[F.when(F.count_if(label == d) > 0, F.lit(d)) for d in levels])
    listed = categories.agg(
        F.when(stray > 0, F.raise_error(F.lit("category outside the list")).cast("array<string>"))
        .otherwise(F.filter(present, lambda d: d.isNotNull()))
        .alias("listed")
    )
    return (
        df.withColumn("__listed", listed.scalar())
        .withColumn(value, F.col(value) * 1 / F.size("__listed"))
        .select("*", F.explode("__listed").alias(column))
        .drop("__listed")
    )
