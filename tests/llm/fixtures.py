"""Small documents with every oddity: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SYLLABLES = ("an", "ber", "co", "du", "el", "fi", "gra", "ho", "in", "jo", "ka", "lu", "mi", "no", "or", "pa")
#: Names that operators use inside.
CLASHES = ("n", "h", "h1", "h2", "key", "value", "node", "cluster", "kept", "rate", "tokens", "bucket", "salt", "base",
           "piece", "length", "often", "drop_id", "drop_list", "rejected_id", "mixed_id", "mixed_times", "duplicate_id",
           "lines", "words", "level", "cut_symbol_rate", "ids", "spans", "part", "source2")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    text = words(rng, n)
    return " ".join(text[: n // 2]) + ".\n" + " ".join(text[n // 2 :]) + "."


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.replace(" ", " ", 1).replace(base.split()[60], "changed", 1)
    shared = "this line is shared by many documents"
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t \n", None, "a"), (4, "word", "en", None), (5, prose(rng, 20_000), "de", "a"),
        (6, base, "en", "a"), (7, near, "en", "a"), (8, base.upper(), "en", "b"), (9, base, "en", "a"), (9, base, "en", "a"),
        (10, prose(rng, 80), None, None), (10, prose(rng, 80), "fr", "c"), (None, prose(rng, 60), "en", "a"), (None, None, None, None),
        (11, "éa 日本 🙂 ́x y\x0bz\x85", "fr", "a"), (12, "*** ### $$$ " * 40, "en", "a"), (13, "same " * 400, "en", "a"),
    ]
    rows += [(100 + i, f"{prose(rng, 70)}\n {shared.title() if i % 2 else shared}\t", "en", "a") for i in range(12)]
    return [(i, t, lang, source, len(t) if t else None) for i, t, lang, source in rows]


def documents(spark, rows=None):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def nothing(spark):
    return documents(spark, [])


def multiset(rows) -> list[str]:
    return sorted(repr(tuple(r)) for r in rows)
