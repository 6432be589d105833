"""Long to wide, wide to long, stacking and the reporting window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens.constants import FIRST_YEAR, LAST_YEAR
from scenlens.functions import strict_sum, strict_sum_where


class DuplicateCell(ValueError):
    """Name used in the message of the job failure for a doubled cell."""


def _named(names) -> dict:
    return names if isinstance(names, dict) else {str(n): n for n in names}


def sum_by(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Strict sum per key, under the name of the summed column."""
    return df.groupBy(*keys).agg(strict_sum(value).alias(value))


def pivot_sums(
    df: DataFrame, ids: Sequence[str], names_from: str | Column, names, value: str = "value"
) -> DataFrame:
    """Strict sums per id, one column per name: sum and pivot in one shuffle.

    `names` is a list of values or `{column name: value}`.  A name without any
    row and a name with a missing value both give NULL.
    """
    key = F.col(names_from) if isinstance(names_from, str) else names_from
    return df.groupBy(*ids).agg(*[
        strict_sum_where(key.eqNullSafe(F.lit(v)), value).alias(n) for n, v in _named(names).items()
    ])


def checked(test: Column) -> Column:
    """A test that fails the job, as a filter that no other filter is moved below: rows that a later `where` takes out
    are tested too."""
    return test & (F.spark_partition_id() >= 0)


def single_cell(here: Column, name: str, ids: Sequence[str], value: str = "value", group: Column | None = None) -> Column:
    """The value of the one row of a group where `here` holds; fails the job when there are more.

    Of grouping sets, `group` says which groups are cells.
    """
    message = F.concat(
        F.lit(f"{DuplicateCell.__name__}: several rows for {name} at "),
        F.to_json(F.struct(*ids)) if ids else F.lit("the single row"),
    )
    several = F.count_if(here) > 1
    return (
        F.when(several if group is None else group & several, F.raise_error(message).cast("double"))
        .otherwise(F.max(F.when(here, F.col(value))))
        .alias(name)
    )


def pivot_cells(
    df: DataFrame, ids: Sequence[str], names_from: str | Column, names, value: str = "value"
) -> DataFrame:
    """One column per name; fails the job when a cell holds more than one row."""
    key = F.col(names_from) if isinstance(names_from, str) else names_from
    return df.groupBy(*ids).agg(*[
        single_cell(key.eqNullSafe(F.lit(v)), n, ids, value) for n, v in _named(names).items()
    ])


def groups_of_all(
    df: DataFrame, ids: Sequence[str], columns: Sequence[Column], present: dict[str, Column], error: str
) -> DataFrame:
    """`columns` aggregated per id; fails the job, naming them with `error`, where a test of `present` holds in no row.

    The whole table is one more group of the same aggregation, so the answer comes out of the groups' own exchange
    and nothing is read twice.  A table without any row passes.
    """
    ids, level, lacking = list(ids), "__level", "__lacking"
    names = F.array_compact(F.array(*[
        F.when(F.bool_or(F.coalesce(test, F.lit(False))), None).otherwise(F.lit(n)) for n, test in present.items()
    ]))
    lacks = F.array_join(names, ", ").alias(lacking)
    fail = F.raise_error(F.concat(F.lit(f"{error}: no row of "), F.col(lacking))).cast("boolean")
    if not ids:
        some = df.groupBy().agg(*columns, F.when(F.count(F.lit(1)) > 0, lacks).otherwise("").alias(lacking))
        return some.where(checked(F.when(F.col(lacking) == "", F.lit(True)).otherwise(fail))).drop(lacking)
    keys = [F.col(f"`{c}`") for c in ids]
    sets = df.groupingSets([keys, []], *keys).agg(F.grouping_id().alias(level), *columns, lacks)
    one = F.when(F.col(level) == 0, F.lit(True)).when(F.col(lacking) == "", F.lit(False)).otherwise(fail)
    return sets.where(checked(one)).drop(level, lacking)


def to_long(
    df: DataFrame, ids: Sequence[str] | None, columns: Sequence[str] | None,
    name: str = "scenario", value: str = "value",
) -> DataFrame:
    """Unpivot, keeping rows whose value is missing.

    `columns=None` takes every column that is not an id.
    """
    ids = list(ids or [])
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(ids, columns, name, value)


def union_all(*tables: DataFrame) -> DataFrame:
    """Stack by column name; a column a table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def year_window(df: DataFrame, after: int = FIRST_YEAR, until: int = LAST_YEAR) -> DataFrame:
    """Rows with `after < year <= until`."""
    return df.where((F.col("year") > after) & (F.col("year") <= until))
