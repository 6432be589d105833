"""Classes for map legends.

A missing value, NaN included, has no class.  `among` picks the rows that are classed, the others get none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values enter k-means as multiples of ten to the minus this.
KMEANS_DIGITS = 6


def _known(value: Column, among: Column | None = None) -> Column:
    """The value as a double; NULL for NaN and outside `among`."""
    value = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return value if among is None else F.when(among, value)


def _class_of(value: Column, breaks: Sequence[float]) -> Column:
    """Number of breaks at or below the value."""
    out = F.lit(0)
    for b in breaks:
        out = out + F.when(value >= F.lit(float(b)), 1).otherwise(0)
    return F.when(value.isNotNull(), out).cast("int")


def fixed_class(df: DataFrame, breaks: Sequence[float], value: str = "value") -> DataFrame:
    """Adds `class`: 0 below the first break, i from the i-th break on."""
    return df.withColumn("class", _class_of(_known(F.col(value)), sorted(breaks)))


def pretty_class(
    df: DataFrame, value: str = "value", pieces: int = 5, among: Column | None = None
) -> DataFrame:
    """Adds `class_from` and `class_to`, neighbouring multiples of a 1-2-5 step; a value on a break is in the class above.

    The step is the round number nearest to a fifth of the range: `digit` times ten to the `power`.  Breaks are
    whole multiples of it, printed with the digits of the step, and a value is held against the printed breaks.
    The step is a scalar subquery over a one-row min/max, evaluated when the result is.
    """
    known = _known(F.col(value), among)
    span = df.agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    cell = (F.col("hi") - F.col("lo")) / pieces
    power = F.floor(F.log10(F.col("cell"))).cast("int")
    bias, bias5 = 1.5, 2.75
    at, u = F.col("cell"), F.pow(F.lit(10.0), F.col("power"))
    digit = (
        F.when(10 * u - at < bias * (at - 5 * u), 10)
        .when(5 * u - at < bias5 * (at - 2 * u), 5)
        .when(2 * u - at < bias * (at - u), 2)
        .otherwise(1)
    )
    step = (
        span.withColumn("cell", F.when(cell > 0, cell)).withColumn("power", F.coalesce(power, F.lit(0)))
        .select(F.struct(F.coalesce(digit, F.lit(1)).alias("digit"), "power").alias("step"))
    )
    digit, power = F.col("__step.digit"), F.col("__step.power")

    def printed(n: Column) -> Column:
        """n steps as a number: a whole number scaled up, or divided once by a power of ten, which rounds once."""
        whole = (n * digit).cast("double")
        return F.when(power >= 0, whole * F.pow(F.lit(10.0), power)).otherwise(whole / F.pow(F.lit(10.0), -power))

    near = F.round(known / printed(F.lit(1))).cast("long")
    low = F.when(known >= printed(near), near).otherwise(near - 1)
    return (
        df.withColumn("__step", step.scalar()).withColumn("__low", low)
        .withColumn("class_from", printed(F.col("__low")))
        .withColumn("class_to", printed(F.col("__low") + 1))
        .drop("__step", "__low")
    )


def kmeans_class(
    df: DataFrame, k: int = 5, value: str = "value", among: Column | None = None, digits: int = KMEANS_DIGITS
) -> DataFrame:
    """Adds `class` 1..k: one-dimensional k-means clusters in rising order.  Runs a job per step when called.

    Centres begin evenly spaced from the least to the greatest value and move to the means of their clusters until
    nothing changes.  A value belongs to the nearest centre, halfway to the upper one; a centre without values stays.
    Values are rounded to `digits` first, so the sums, and with them the classes, do not depend on the order of
    rows.  The driver sees k sums a step.  Without any value all classes are missing.
    """
    scaled = F.bround(_known(F.col(value), among) * 10**digits, 0)
    points = df.select(scaled.cast("decimal(30,0)").alias("v")).where("v IS NOT NULL").persist()
    lo, hi = points.agg(F.min("v").cast("double"), F.max("v").cast("double")).first()
    if lo is None:
        return df.withColumn("class", F.lit(None).cast("int"))
    centres = [lo + (hi - lo) * i / (k - 1) if k > 1 else lo for i in range(k)]
    while True:
        cuts = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
        at = _class_of(F.col("v").cast("double"), cuts)
        sums = points.agg(*[
            x for i in range(k) for x in (F.sum(F.when(at == i, F.col("v"))).cast("double"), F.count_if(at == i))
        ]).first()
        moved = [sums[2 * i] / sums[2 * i + 1] if sums[2 * i + 1] else centres[i] for i in range(k)]
        if moved == centres:
            points.unpersist()
            return df.withColumn("class", (_class_of(scaled, cuts) + 1).cast("int"))
        centres = moved
