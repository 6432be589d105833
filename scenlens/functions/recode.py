"""Recodes driven by rule tables.

A rule is `(kind, pattern, label)` with kind `has` (regular expression found
anywhere) or `is` (exact text).  Rule tables are data, so a study with other
labels passes other rules; the expression stays one CASE.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenlens.functions.nulls import contains

Rule = tuple[str, str, str]


def _test(text: Column, kind: str, pattern: str) -> Column:
    if kind == "has":
        return contains(text, pattern)
    if kind == "is":
        return text.eqNullSafe(F.lit(pattern))
    raise ValueError(f"unknown rule kind {kind!r}")


def recode_first(text: Column | str, rules: Iterable[Rule], default: Column | None = None) -> Column:
    """Label of the first rule that matches, else `default` (the text itself)."""
    text = F.col(text) if isinstance(text, str) else text
    out = F
    for kind, pattern, label in rules:
        out = out.when(_test(text, kind, pattern), F.lit(label))
    if out is F:
        return text if default is None else default
    return out.otherwise(text if default is None else default)


def recode_last(text: Column | str, rules: Sequence[Rule], default: Column | None = None) -> Column:
    """Label of the last rule that matches: later rules overwrite earlier ones."""
    return recode_first(text, list(reversed(list(rules))), default)


def ordinal(text: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in an ordered list of levels; NULL outside the list."""
    text = F.col(text) if isinstance(text, str) else text
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), text)
    return F.nullif(position, F.lit(0)).cast("int")


def patch(value: Column | str, patches: Iterable[tuple[dict, float]]) -> Column:
    """Overwrite the cells named by `({column: wanted, ...}, new value)` pairs."""
    out = F.col(value) if isinstance(value, str) else value
    for cell, new in patches:
        hit = F.lit(True)
        for name, wanted in cell.items():
            hit = hit & F.col(name).eqNullSafe(F.lit(wanted))
        out = F.when(hit, F.lit(float(new))).otherwise(out)
    return out
