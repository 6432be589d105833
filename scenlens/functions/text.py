"""Splitting labels that carry several facts in one text.

Plain substring functions do most of the work: splitting on a regular
expression compiles it for every row and costs tens of times a sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def separator_piece(text: Column | str, sep: str, n: int) -> Column:
    """n-th piece between literal separators, NULL if absent."""
    text = _col(text)
    piece = F.substring_index(F.substring_index(text, sep, n), sep, -1)
    if n == 1:
        return piece
    return F.when(F.substring_index(text, sep, n - 1) != text, piece)


def alnum_piece(text: Column | str, n: int) -> Column:
    """n-th piece between runs of non-alphanumeric characters, NULL if absent."""
    return separator_piece(F.regexp_replace(_col(text), "[^A-Za-z0-9]+", "_"), "_", n)


def _before_tail(text: Column, tail: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - F.length(tail) - 1)


def split_last(text: Column | str) -> tuple[Column, Column]:
    """Text before and after the last underscore; no underscore: (text, NULL)."""
    text = _col(text)
    tail = F.substring_index(text, "_", -1)
    has = text.contains("_")
    return F.when(has, _before_tail(text, tail)).otherwise(text), F.when(has, tail)


def split_decile(text: Column | str) -> tuple[Column, Column]:
    """Split `..._d7` into label and decile.

    Only a trailing `d<number>` is a decile.  Any other label stays whole and
    has no decile, so `trn_aviation_intl` does not become decile `intl`.
    """
    text = _col(text)
    tail = F.substring_index(text, "_", -1)
    has = text.contains("_") & tail.rlike("^d[0-9]+$")
    return F.when(has, _before_tail(text, tail)).otherwise(text), F.when(has, tail)
