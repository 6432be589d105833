"""Column expressions that keep the missing-value rules of the study.

Spark skips NULL in aggregates, drops it in negated predicates and, in ANSI
mode, throws on division by zero.  The results need the stricter rules below;
all of them are built-in expressions, so they stay inside generated code and
keep Spark's map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_REGEX_MARKS = set(r".^$*+?{}[]()\\")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(v: Column | str) -> Column:
    """Sum that is NULL as soon as one value of the group is NULL."""
    v = _col(v)
    return F.when(F.count(F.lit(1)) == F.count(v), F.sum(v))


def strict_sum_where(cond: Column, v: Column | str) -> Column:
    """`strict_sum` over the rows where `cond` holds; NULL when there is none.

    Several of these in one `agg` sum and pivot in a single shuffle.
    """
    kept = F.when(cond, _col(v))
    return F.when(F.count_if(cond) == F.count(kept), F.sum(kept))


def sum0(v: Column | str) -> Column:
    """Sum that skips NULL and gives 0 for a group without any value."""
    return F.coalesce(F.sum(_col(v)), F.lit(0.0))


def strict_avg(v: Column | str) -> Column:
    """Mean that is NULL as soon as one value of the group is NULL."""
    v = _col(v)
    return F.when(F.count(F.lit(1)) == F.count(v), F.avg(v))


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Quotient, NULL for a zero divisor instead of an exception."""
    return F.try_divide(_col(num), _col(den))


def half_even(v: Column | str, digits: int = 0) -> Column:
    """Round, ties to the even neighbour."""
    return F.bround(_col(v), digits)


def number_text(v: Column | str, digits: int) -> Column:
    """Rounded number as report text: `61`, `2.5`, `0`, never `61.0` or `-0.0`.

    NULL, NaN and infinities give NULL.
    """
    rounded = F.bround(_col(v), digits).try_cast(f"decimal(38,{digits})").cast("string")
    if digits == 0:
        return F.regexp_replace(rounded, r"^-0$", "0")
    trimmed = F.regexp_replace(F.regexp_replace(rounded, "0+$", ""), r"\.$", "")
    return F.regexp_replace(trimmed, r"^-0$", "0")


def contains(v: Column | str, pattern: str) -> Column:
    """Test for a pattern anywhere in a text; false, not NULL, for missing text.

    `~contains(x, p)` therefore keeps rows whose text is missing.  Alternatives
    of plain words (`coal|oil`) become substring searches, which are far cheaper
    than the regular expression any other pattern is matched with.
    """
    text = _col(v)
    words = pattern.split("|")
    if any(ch in _REGEX_MARKS for word in words for ch in word) or "" in words:
        found = text.rlike(pattern)
    else:
        found = text.contains(words[0])
        for word in words[1:]:
            found = found | text.contains(word)
    return F.coalesce(found, F.lit(False))


def not_in_nor_null(v: Column | str, values) -> Column:
    """Neither one of `values` nor missing."""
    v = _col(v)
    return v.isNotNull() & ~v.isin(list(values))


def choose(cond: Column, yes, no) -> Column:
    """Two-way choice where a NULL condition gives NULL, not the `no` branch."""
    yes, no = (x if isinstance(x, Column) else F.lit(x) for x in (yes, no))
    return F.when(cond, yes).when(~cond, no)


def absent_as_zero(v: Column | str) -> Column:
    """NULL and NaN become 0."""
    return F.coalesce(F.nanvl(_col(v), F.lit(None).cast("double")), F.lit(0.0))
