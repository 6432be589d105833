"""Fill a yearly grid by linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annual_series(
    df: DataFrame, keys: Sequence[str], first: int, last: int, value: str = "value"
) -> DataFrame:
    """Every year of `first..last` for every series of `keys`.

    Known years keep their value, years between two known ones get the point on
    the line, years outside the known range are NULL, and so is a series with
    fewer than two known years.  Two rows for one year fail the job.

    Rows are first reduced to one per key and year, map-side, so the list kept
    per series never exceeds the length of the grid however large a series is.
    """
    keys = list(keys)
    message = F.concat(F.lit("annual_series: several rows for "), F.to_json(F.struct(*keys, "year")))
    yearly = (
        df.where(F.col("year").between(first, last))
        .groupBy(*keys, "year")
        .agg(
            F.when(F.count(F.lit(1)) > 1, F.raise_error(message).cast("double"))
            .otherwise(F.max(value))
            .alias(value)
        )
    )
    series = yearly.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.when(F.col(value).isNotNull(), F.struct("year", F.col(value).alias("v"))))
        ).alias("known")
    )

    def point(year):
        before = F.try_element_at(F.filter("known", lambda k: k["year"] <= year), F.lit(-1))
        after = F.try_element_at(F.filter("known", lambda k: k["year"] >= year), F.lit(1))
        step = after["year"] - before["year"]
        on_line = before["v"] + (after["v"] - before["v"]) * (year - before["year"]) / F.nullif(step, F.lit(0))
        return F.struct(
            year.alias("year"),
            F.when(F.size("known") >= 2, F.when(step == 0, before["v"]).otherwise(on_line)).alias(value),
        )

    grid = F.transform(F.sequence(F.lit(first), F.lit(last)), point)
    return series.select(*keys, F.inline(grid))
