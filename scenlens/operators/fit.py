"""Least-squares lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_line(df: DataFrame, group: Sequence[str], y: str, x: str) -> DataFrame:
    """Line `y = intercept + slope * x` per group; pairs with a gap are left out."""
    return df.groupBy(*group).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
        F.regr_count(F.col(y), F.col(x)).alias("n"),
    )
