"""Lookups that refuse to lose or multiply rows.

No join here forces a broadcast of data that can grow: tables written in code
(`inline_table`) carry a hint because their size is fixed, every other side is
left to Spark, which compares its measured size with
`spark.sql.autoBroadcastJoinThreshold` and otherwise shuffles (with AQE's
skew-join splitting for hot keys).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenlens.operators.reshape import checked

_COPIES = "__copies"


def inline_table(
    spark: SparkSession, rows: Sequence[tuple], schema: str, key: Sequence[str] = ()
) -> DataFrame:
    """Small table written in code, as a local relation with a broadcast hint.

    `key` names columns that identify a row; doubled keys are an error here, so
    `strict_lookup` need not count them again.
    """
    fields = T.StructType.fromDDL(schema).fields
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrow_types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    table = pa.table({
        f.name: pa.array(list(c), arrow_types[f.dataType.simpleString()])
        for f, c in zip(fields, columns)
    })
    df = F.broadcast(spark.createDataFrame(table))
    if key:
        if len(set(zip(*[table[k].to_pylist() for k in key]))) < len(rows):
            raise ValueError(f"doubled key {list(key)} in an inline table")
        df.verified_key = tuple(key)
    return df


def verified_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Checks once, with a job, that `key` identifies the rows of `df`.

    The returned table carries that fact to `strict_lookup`; tables derived
    from it do not.
    """
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias(_COPIES)).where(F.col(_COPIES) > 1).take(1)
    if twice:
        raise ValueError(f"doubled key {twice[0].asDict()}")
    df.verified_key = tuple(key)
    return df


def lookup(df: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on the shared columns `on`, where missing keys match each other.

    Besides being the rule of the study, null-safe keys keep the optimizer from
    adding "key is not null" filters to `right`.  For keys read out of labels
    such filters would move below the aggregation and parse every raw row.
    """
    on = list(on)
    extra = [c for c in right.columns if c not in on]
    keyed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on])
    return df.join(keyed, same, "left").select(*[F.col(f"`{c}`") for c in [*df.columns, *extra]])


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows, which a job counts no further than that; else as it is.

    For the small side of a lookup of many rows, where Spark's estimate of an aggregated table is far too high.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def strict_lookup(
    df: DataFrame, right: DataFrame, on: Sequence[str], *, unique: bool = False
) -> DataFrame:
    """`lookup` that fails the job when a row finds no match or several.

    The check is a filter on the joined rows that no later filter is moved below: it is not
    pruned away when the looked-up columns are unused, and a row that a later `where` takes out is checked as well.
    Filters that are to reach the files go before the lookup.

    `unique=True` states that `on` is a key of `right` by construction (for
    example right after a group-by on it) and saves the counting step, as does
    a table from `verified_key`.
    """
    on = list(on)
    known = getattr(right, "verified_key", None)
    if unique or (known and set(known) <= set(on)):
        counted = right.withColumn(_COPIES, F.lit(1))
    else:
        counted = right.groupBy(*on).agg(
            *[F.any_value(c).alias(c) for c in right.columns if c not in on],
            F.count(F.lit(1)).alias(_COPIES),
        )
    key_text = F.to_json(F.struct(*on))

    def fail(what: str):
        return F.raise_error(F.concat(F.lit(f"strict lookup: {what} for "), key_text)).cast("boolean")

    copies = F.col(_COPIES)
    matched = F.when(copies.isNull(), fail("no match")).when(copies > 1, fail("several matches")).otherwise(F.lit(True))
    return lookup(df, counted, on).where(checked(matched)).drop(_COPIES)


def unmatched(df: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of `df` without a partner: an empty result means all match."""
    on = list(on)
    return df.select(*on).distinct().join(right, on, "left_anti")


def cross_with(df: DataFrame, **columns) -> DataFrame:
    """Repeat every row for each combination of the listed literal values."""
    for name, values in columns.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
