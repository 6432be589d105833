"""Quality rules whose cut-offs come from the data, per language and source.

Each text is measured inside its row.  A measure's distribution in a group is kept as a sketch of counts in
log-linear buckets (relative width 1/32), which merge by adding: partial sums meet in a group-by, and the
sketches of a language are the sums of its sources'.  A document is rejected where a measure lies beyond a
far fence of its group: the third quartile and `FENCE` times the spread of the quartiles, which is that of the
language or of all where the group's is narrower.  No cut-off is a fixed number: a measure whose quartiles
coincide over the whole table has no scale and rejects nothing.  Everything is DataFrame functions; a hot source is a few
hundred sketch rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenlens.llm.shared import free_name, stored

MIN_GROUP = 100
MIN_WORDS = 50
FENCE = 5.0
BROADCAST_ROWS = 100_000

_SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"


def _steps(text: str) -> list[dict[str, str]]:
    """Columns of the measures, in steps: a column read in a lambda is read twice, so it is computed once."""
    return [
        {
            "_text": f"coalesce(`{text}`, '')",
        },
        {
            "_words": f"filter(split(_text, '{_SPACE}'), x -> x != '')",
            "_lines": "filter(transform(split(_text, '\\n', -1), l -> l), l -> btrim(l, ' \\t\\n\\u000B\\f\\r') != '')",
            "word_chars": f"char_length(regexp_replace(_text, '{_SPACE}', ''))",
            "n_symbols": "char_length(_text) - char_length(translate(_text, '#*$%&|<>', ''))",
            "n_upper": "char_length(_text) - char_length(regexp_replace(_text, '\\\\p{Lu}+', ''))",
            "n_letters": "char_length(_text) - char_length(regexp_replace(_text, '\\\\p{L}+', ''))",
            "n_other": "char_length(regexp_replace(_text, '[\\\\p{L}\\\\p{M}\\\\p{N}\\\\p{Z}\\\\x09-\\\\x0D]+', ''))",
        },
        {
            "n_words": "size(_words)",
            "n_lines": "size(_lines)",
            "n_dup_lines": "size(_lines) - size(array_distinct(_lines))",
            "_triples": "CASE WHEN size(_words) > 2 THEN transform(sequence(0, size(_words) - 3),"
                        " i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) ELSE array() END",
        },
        {
            "_ranked": "CASE WHEN size(_triples) > size(array_distinct(_triples))"
                       " THEN sort_array(transform(_triples, (h, i) -> struct(h, i))) ELSE array() END",
        },
        {
            "_twice": "sort_array(transform(filter(_ranked, (x, j) ->"
                      " x.h <=> get(_ranked, j - 1).h OR x.h <=> get(_ranked, j + 1).h), x -> x.i))",
        },
        {
            "n_repeat_words": "aggregate(transform(_twice, (i, k) -> least(3, coalesce(get(_twice, k + 1) - i, 3))),"
                              " 0, (a, b) -> a + b)",
        },
    ]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_other")


def measured(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of `keep` and the counts of every row's whole text; null text has none."""
    names = list(keep)
    df = docs.select(*[c.alias(n) for n, c in keep.items()], F.expr(f"`{text}`").alias("_raw"))
    for step in _steps("_raw"):
        df = df.select("*", *[F.expr(e).alias(n) for n, e in step.items()])
    return df.select(*names, *[F.col(c).cast("long").alias(c) for c in COUNTS])


#: The measures, in thousandths, that may lie too high: part and whole of each.
RATES = {
    "other_rate": ("n_other", "word_chars"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "caps_rate": ("n_upper", "n_letters"),
}


def rates() -> dict[str, Column]:
    """Columns of the measures; 0 where the whole is."""
    return {
        m: F.expr(f"CASE WHEN {whole} > 0 THEN 1000 * {part} DIV {whole} ELSE 0 END") for m, (part, whole) in RATES.items()
    }


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")


def bucket(value: Column) -> Column:
    """Bucket of a non-negative integer: itself below 64, from there 32 buckets to each doubling."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return shift * 32 + F.expr("1") * F.floor(value / F.pow(F.lit(2.0), shift)).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.greatest(F.lit(0), F.floor(b / 32).cast("int") - 1)
    return ((b - shift * 32 + 1) * F.pow(F.lit(2.0), shift)).cast("long") - 1


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, level, measure, bucket, n: sketches of each language and source, language, and all."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in RATES]))
    own = rows.select("lang", "source", pairs.alias("p")).groupBy(
        "lang", "source", "p.measure", "p.bucket"
    ).agg(F.count("*").alias("n"))
    by_level = F.explode(F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")),
    ))
    merged = own.select(by_level.alias("g"), "measure", "bucket", "n")
    return merged.groupBy("g.level", "g.lang", "g.source", "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """level, lang, source, measure, q3 (third quartile), spread (its distance from the first).

    Groups of fewer than `min_group` documents give none.
    """
    group = ["level", "lang", "source", "measure"]
    up_to = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sketch.select(
        *group, "bucket", F.sum("n").over(up_to).alias("up_to"), F.sum("n").over(Window.partitionBy(*group)).alias("all")
    )
    at = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("all") * q, bucket_top(F.col("bucket"))))
    return ranked.where(F.col("all") >= min_group).groupBy(*group).agg(
        at(3).alias("q3"), (at(3) - at(1)).alias("spread")
    )


def _cuts(rows: DataFrame, fence: float, min_group: int) -> DataFrame:
    """One row per language and source: the third quartile of its own sketch, else its language's, else everyone's, and
    `fence` times the widest of their spreads; none where everyone's is 0."""
    found = fences(sketches(rows), min_group)
    wide = found.groupBy("level", "lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in RATES for c in ("q3", "spread")
    ])
    groups = rows.select("lang", "source").distinct().alias("g")
    own, lang, every = (wide.where(F.col("level") == k).alias(f"l{k}") for k in (2, 1, 0))
    joined = (
        groups.join(own, F.col("l2.lang").eqNullSafe(F.col("g.lang")) & F.col("l2.source").eqNullSafe(F.col("g.source")), "left")
        .join(lang, F.col("l1.lang").eqNullSafe(F.col("g.lang")), "left")
        .join(F.broadcast(every), F.lit(True), "left")  # a single row
    )

    def cut(m: str) -> Column:
        q3 = F.coalesce(*[F.col(f"{t}.q3_{m}") for t in ("l2", "l1", "l0")])
        spread = F.greatest(*[F.col(f"{t}.spread_{m}") for t in ("l2", "l1", "l0")])
        return F.when(F.col(f"l0.spread_{m}") > 0, q3 + F.floor(spread * F.lit(fence)).cast("long"))

    return joined.select("g.lang", "g.source", *[cut(m).alias(f"cut_{m}") for m in RATES])


def judged(docs: DataFrame, keep: dict[str, Column], fence: float = FENCE, min_group: int = MIN_GROUP) -> DataFrame:
    """The columns of `keep` of every row, its counts, base_failed, the cut-offs of its group, and kept."""
    named = {f"_keep_{n}": c for n, c in keep.items()}
    rows = stored(measured(docs, named | {
        "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"),
    }).withColumns(rates()), "quality-measures")
    cuts = stored(_cuts(rows, fence, min_group), "quality-cuts")
    small = cuts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = cuts.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"cut_{m}" for m in RATES])
    joined = rows.join(
        F.broadcast(side) if small else side,
        F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left",
    )
    over = F.lit(False)
    for m in RATES:
        over = over | F.coalesce(F.col(m) > F.col(f"cut_{m}"), F.lit(False))
    return joined.select(
        *[F.col(f"_keep_{n}").alias(n) for n in keep], *COUNTS, *RATES, *[f"cut_{m}" for m in RATES],
        base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"),
    )


def quality_scores(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the counts of its whole text, the cut-offs, base_failed and kept, for every row.

    Null text counts as empty, which fails the base rule (under 50 words).  A null language or source is a
    group like others.  Groups of fewer than `min_group` rows take their language's cut-offs, then
    everyone's, then none; a measure without spread over the whole table has none.  Repeated rows count each; an empty table gives
    no rows; other columns are not read.
    """
    return judged(docs, {"doc_id": F.col("doc_id")}, **options)


def drop_poor(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass, with all their columns.

    Rows are told apart by id, text, language and source, nulls being values like others: a row goes only with rows
    that are equal to it in all four.  Repeated rows stay or go together; an empty table gives no rows.
    """
    identity = {
        "doc_id": F.col("doc_id"), "key": F.xxhash64("text"),
        "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"),
    }
    names = {n: free_name(docs, f"rejected_{n}") for n in identity}
    rejected = judged(docs, identity, **options).where(~F.col("kept"))
    rejected = stored(rejected.select(*[F.col(n).alias(o) for n, o in names.items()]).distinct(), "rejected")
    small = rejected.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = F.lit(True)
    for n, c in identity.items():
        same = same & c.eqNullSafe(F.col(names[n]))
    return docs.join(F.broadcast(rejected) if small else rejected, same, "left_anti")
