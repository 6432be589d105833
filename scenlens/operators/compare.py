"""Measure scenarios against a baseline or a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens.constants import PERCENT
from scenlens.functions import safe_div, strict_sum, strict_sum_where
from scenlens.operators.reshape import groups_of_all, pivot_cells, pivot_sums, single_cell, sum_by, to_long
from scenlens.scenarios import ScenarioFamily


class AbsentScenario(ValueError):
    """Name used in the message of the job failure for a scenario without any row."""


def change(kind: str, variant: Column, baseline: Column) -> Column:
    """One comparison: `abs`, `fraction`, `percent` or `ratio`."""
    if kind == "abs":
        return variant - baseline
    if kind == "fraction":
        return safe_div(variant - baseline, baseline)
    if kind == "percent":
        return safe_div(variant - baseline, baseline) * PERCENT
    if kind == "ratio":
        return safe_div(variant, baseline)
    raise ValueError(f"unknown kind of change {kind!r}")


def spread(
    df: DataFrame, ids: Sequence[str], family: ScenarioFamily, value: str = "value",
    raw: str = "scenario", cells: str = "summed", complete: bool = True,
) -> DataFrame:
    """One column per canonical scenario; a scenario of the family that is in no row fails the job if `complete`.

    `cells` says what a cell may hold.  `summed`: the rows of one run, added up by the raw label as it
    stands, so that labels are read once per cell and not once per row; a second run of the same canonical
    name fails.  `merged`: all rows of all runs of the name, added up.  `single`: exactly one row.
    """
    if cells not in ("summed", "merged", "single"):
        raise ValueError(f"unknown kind of cells {cells!r}")
    rows = df if cells == "single" else sum_by(df, [raw, *ids], value)
    name = family.canonical(raw)
    if not complete:
        return (pivot_sums if cells == "merged" else pivot_cells)(rows, ids, name, family.names, value)
    if cells == "merged":
        columns = [strict_sum_where(name.eqNullSafe(F.lit(n)), value).alias(n) for n in family.names]
    else:
        columns = [single_cell(name.eqNullSafe(F.lit(n)), n, ids, value, _cell(ids)) for n in family.names]
    return groups_of_all(rows, ids, columns, _present(family, raw), AbsentScenario.__name__)


def _cell(ids: Sequence[str]) -> Column | None:
    """Whether a group is a cell and not the whole table."""
    return F.grouping_id() == 0 if ids else None


def _present(family: ScenarioFamily, raw: str) -> dict[str, Column]:
    return {n: family.canonical(raw) == n for n in family.names}


def compare(
    df: DataFrame, ids: Sequence[str], family: ScenarioFamily, kind: str = "abs",
    value: str = "value", out: str = "value", raw: str = "scenario", cells: str = "summed",
) -> DataFrame:
    """Long table of every variant measured against the baseline."""
    wide = spread(df, ids, family, value, raw, cells)
    base = F.col(family.baseline)
    measured = wide.select(
        *ids, *[change(kind, F.col(v), base).alias(family.reported(v)) for v in family.variants]
    )
    return to_long(measured, ids, [family.reported(v) for v in family.variants], "scenario", out)


def net_and_relative(
    df: DataFrame, group: Sequence[str], detail: Sequence[str], family: ScenarioFamily,
    value: str = "value", raw: str = "scenario",
) -> DataFrame:
    """Net change and relative change of the total, side by side.

    The net change adds up the differences of the `detail` cells, so it is NULL
    when a scenario lacks a cell.  The relative change compares the totals of
    the cells each scenario has.  Both come from one pass over the cells; a second
    run of the same canonical name in a cell fails the job.
    """
    summed = sum_by(df, [raw, *group, *detail], value)
    name = family.canonical(raw)
    keys = [*group, *detail]
    columns = [
        column
        for n in family.names
        for column in (
            single_cell(name == n, n, keys, value, _cell(keys)), (F.count_if(name == n) > 0).alias(f"__has_{n}"),
        )
    ]
    cells = groups_of_all(summed, keys, columns, _present(family, raw), AbsentScenario.__name__)
    totals = cells.groupBy(*group).agg(
        *[strict_sum_where(F.col(f"__has_{n}"), n).alias(n) for n in family.names],
        *[
            strict_sum(change("abs", F.col(v), F.col(family.baseline))).alias(f"__net_{v}")
            for v in family.variants
        ],
    )
    rows = F.array(*[
        F.struct(
            F.lit(family.reported(v)).alias("scenario"),
            F.col(f"__net_{v}").alias("total_value"),
            change("percent", F.col(v), F.col(family.baseline)).alias("annual_change"),
        )
        for v in family.variants
    ])
    return totals.select(*group, F.inline(rows))


def gap_to_target(df: DataFrame, target: str, scenarios, ids: Sequence[str], out: str) -> DataFrame:
    """Long table of `target - scenario`; negative means the target is missed.

    `scenarios` maps the reported name to the column that holds the scenario.
    """
    gaps = df.select(*ids, *[(F.col(target) - F.col(c)).alias(n) for n, c in scenarios.items()])
    return to_long(gaps, ids, list(scenarios), "scenario", out)
