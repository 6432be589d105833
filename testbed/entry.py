"""One registered query: a Spark function and the SQL that must agree with it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens.constants import REGIONS
from scenlens.sources import shared_folder
from testbed.tables import DUCK, Testbed, side_sql, study_sql


@dataclass(frozen=True)
class Entry:
    """`digits` rounds the named columns on both sides before the comparison."""

    run: Callable[[Testbed], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)

    def frame(self, tb: Testbed) -> DataFrame:
        df = self.run(tb)
        for column, n in self.digits.items():
            df = df.withColumn(column, F.bround(f"`{column}`", n) + F.lit(0.0))
        return df

    def oracle(self) -> str | None:
        if self.sql is None or not self.digits:
            return self.sql
        swaps = ", ".join(f'round_even("{c}", {n}) + 0.0 AS "{c}"' for c, n in self.digits.items())
        return f"SELECT * REPLACE ({swaps}) FROM ({self.sql}) AS unrounded"


def fresh(t, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(t.spark)}/scenlens/{name}-{uuid.uuid4().hex}"


def strict(value: str, cond: str | None = None) -> str:
    """SQL of a sum that is NULL when a counted value is."""
    if cond is None:
        return f"CASE WHEN count(*) = count({value}) THEN sum({value}) END"
    return (
        f"CASE WHEN count(*) FILTER (WHERE {cond}) = count({value}) FILTER (WHERE {cond}) "
        f"THEN sum({value}) FILTER (WHERE {cond}) END"
    )


def canon(base: str = "RegGHGPol_Ineq", label: str = "Baseline", column: str = "scenario") -> str:
    return (
        f"CASE WHEN contains({column}, 'Gini25') THEN 'Gini25' WHEN contains({column}, 'Gini50') THEN 'Gini50' "
        f"WHEN contains({column}, '{base}') THEN '{label}' ELSE {column} END"
    )


def region_rows() -> str:
    rows = ", ".join(f"({i}, '{r}', '{a}')" for i, r, a in REGIONS)
    return f"(SELECT * FROM (VALUES {rows}) AS t(region_id, region, region_agg))"


def display(column: str = "region") -> str:
    return (
        f"CASE WHEN contains({column}, 'Caribbean') THEN 'CAC' WHEN contains({column}, 'Trade') THEN 'EFTA' "
        f"ELSE replace({column}, '_', ' ') END"
    )


def study(tables: dict[str, str], body: str, family: str = "policy", **ctes: str) -> str:
    """WITH clause of the named tables and further steps, then the body."""
    parts = [f"{alias} AS ({study_sql(name, DUCK, family)})" for alias, name in tables.items()]
    parts += [f"{alias} AS ({text})" for alias, text in ctes.items()]
    return f"WITH {', '.join(parts)} {body}"


def side(names, body: str, **ctes: str) -> str:
    parts = [f"{n} AS ({side_sql(n, DUCK)})" for n in names]
    parts += [f"{alias} AS ({text})" for alias, text in ctes.items()]
    return f"WITH {', '.join(parts)} {body}"


CHANGE = {
    "abs": "{v} - {b}",
    "fraction": "({v} - {b}) / nullif({b}, 0)",
    "percent": "({v} - {b}) / nullif({b}, 0) * 100",
    "ratio": "{v} / nullif({b}, 0)",
}


def wide(src: str, ids: str, value: str = "value", baseline: str = "Baseline") -> str:
    """SQL of strict sums per id with columns b, g25, g50; `src` has canonical scenarios."""
    cells = ", ".join(
        f"{strict(value, f'scenario = {chr(39)}{s}{chr(39)}')} AS {c}"
        for s, c in ((baseline, "b"), ("Gini25", "g25"), ("Gini50", "g50"))
    )
    group = f" GROUP BY {ids}" if ids else ""
    return f"SELECT {ids + ', ' if ids else ''}{cells} FROM {src}{group}"


def long(src: str, ids: str, kind: str = "abs", out: str = "value", suffix: str = "") -> str:
    """SQL of the long change table over a `wide` relation."""
    lead = ids + ", " if ids else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{name}{suffix}' AS scenario, {CHANGE[kind].format(v=c, b='b')} AS {out} FROM {src}"
        for name, c in (("Gini25", "g25"), ("Gini50", "g50"))
    )


def number_text(value: str, digits: int) -> str:
    text = f"CAST(CAST(round_even({value}, {digits}) AS DECIMAL(38, {digits})) AS VARCHAR)"
    if digits:
        text = f"regexp_replace(regexp_replace({text}, '0+$', ''), '\\.$', '')"
    return f"regexp_replace({text}, '^-0$', '0')"


def pretty(src: str, among: str = "TRUE") -> str:
    """SQL of `src` with the break below and above each value, found in a generated list of breaks."""
    known = f"value IS NOT NULL AND NOT isnan(value) AND {among}"
    return f"""SELECT x.*, class_from, class_to FROM {src} AS x LEFT JOIN (
        SELECT m * d AS n, CASE WHEN p >= 0 THEN (m * d) * pow(10e0, p) ELSE (m * d) / pow(10e0, -p) END AS class_from,
            CASE WHEN p >= 0 THEN ((m + 1) * d) * pow(10e0, p) ELSE ((m + 1) * d) / pow(10e0, -p) END AS class_to
        FROM (SELECT p, d, unnest(generate_series(CAST(floor(lo / (d * u)) AS BIGINT) - 2, CAST(floor(hi / (d * u)) AS BIGINT) + 2)) AS m
            FROM (SELECT *, coalesce(CASE WHEN 10 * u - c < 1.5e0 * (c - 5 * u) THEN 10 WHEN 5 * u - c < 2.75e0 * (c - 2 * u) THEN 5
                WHEN 2 * u - c < 1.5e0 * (c - u) THEN 2 END, 1) AS d
                FROM (SELECT *, pow(10e0, p) AS u FROM (SELECT *, coalesce(CAST(floor(log10(c)) AS INTEGER), 0) AS p
                FROM (SELECT min(value) AS lo, max(value) AS hi, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) / 5 END AS c
                FROM {src} WHERE {known}) AS r) AS q) AS e) AS t) AS s
    ) AS breaks ON {known} AND value >= class_from AND value < class_to"""


def kmeans(src: str, k: int = 5, among: str = "TRUE") -> str:
    """SQL of `src` with its k-means class: centres from evenly spaced seeds, moved until none does."""
    known = f"value IS NOT NULL AND NOT isnan(value) AND {among}"
    whole = "CAST(round_even(value * 1000000, 0) AS HUGEINT)"
    at = f"1 + len(list_filter(range(1, {k}), lambda j: CAST(v AS DOUBLE) >= (cs[j] + cs[j + 1]) / 2))"
    return f"""SELECT x.* EXCLUDE (v), CASE WHEN {known} THEN CAST({at} AS INTEGER) END AS class
        FROM (SELECT *, CASE WHEN {known} THEN {whole} END AS v FROM {src}) AS x, (
        WITH RECURSIVE pts AS (SELECT {whole} AS v FROM {src} WHERE {known}),
        km AS (SELECT 0 AS it, list(lo + (hi - lo) * i / {k - 1} ORDER BY i) AS cs, CAST(NULL AS DOUBLE[]) AS prev
            FROM (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM pts) AS r, (SELECT unnest(range({k})) AS i) AS g
        UNION ALL SELECT it + 1, list(coalesce(a, cs[i]) ORDER BY i), cs FROM (
            SELECT it, cs, i, CAST(sum(v) FILTER (WHERE cls = i) AS DOUBLE) / nullif(count(*) FILTER (WHERE cls = i), 0) AS a
            FROM (SELECT it, cs, v, {at} AS cls FROM km, pts WHERE prev IS NULL OR cs <> prev) AS p,
                (SELECT unnest(range(1, {k + 1})) AS i) AS g GROUP BY it, cs, i) AS n GROUP BY it, cs)
        SELECT arg_max(cs, it) AS cs FROM km) AS fixed"""


WINDOW = "year > 2015 AND year <= 2050"
