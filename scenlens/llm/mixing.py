"""Mixes documents to target token weights of domains that a classifier gives them softly.

A table of labelled rows teaches, for hashed words, how much likelier each domain is with a word than without it; a
document's posterior over the domains is the softmax of its words' log-odds and the domains' shares.  Nonnegative rates are then
fitted so that the expected tokens of every domain match the targets: least squares, each domain in its own tokens, by
projected gradient steps with momentum until they settle; each sums the whole corpus.  Rates depend on the posterior
alone, so documents of one posterior cell (a grid of 1/CELLS) share theirs; the sums use exact posteriors.  Everything
is DataFrame functions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens.llm.shared import drop_stored, free_name, stored

BUCKETS = 1 << 20
#: Standard deviations that a bucket's count in some domain is off the expected; other buckets count as one.
TELLING = 5.0
LEAST_SEEN = 10
#: Occurrences, split as the domains are, that a bucket is taken to have besides those seen.
PRIOR_SEEN = 5.0
#: Different words whose evidence a long text counts for: its mean log-odds times so many.
EVIDENCE = 200
CELLS = 40
RIDGE = 1e-3
#: How far the last gradient step may move a rate; the rates are then off by some 2 * TOLERANCE / RIDGE in the mean square.
TOLERANCE = 1e-6
#: Steps after which the cells' state is written, so that no expression holds more.
HELD_STEPS = 32
BROADCAST_ROWS = 200_000
#: Cells that take their steps in one row; of more, each step is a Spark sum.
ROW_CELLS = 20_000
#: Labelled rows that the classifier learns from, about and at most.
LABELLED_ROWS = 100_000
_SPACE = "[\\x20\\x09-\\x0D]+"


def _words(text: str) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed != "", F.split(trimmed, _SPACE)).otherwise(F.array().cast("array<string>"))


def _kinds(text: str) -> Column:
    """Buckets of the different words of a text: a word counts once, however often it is repeated."""
    return F.array_distinct(F.transform(_words(text), lambda w: F.pmod(F.xxhash64(F.rtrim(w, F.lit(".,"))), F.lit(BUCKETS)).cast("int")))


def word_table(labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float], list[float], bool]:
    """bucket and a log-odds column per domain (o_0, ...) of telling buckets, at most BUCKETS rows; the log-odds of all
    other words together; the domains' shares of the words; and whether there was any.

    `labelled` has text and domain; rows without either, or with a domain that is not asked for, teach nothing.
    """
    k = range(len(domains))
    seen = labelled.where(F.col("domain").isin(domains)).select("domain", F.explode(_kinds("text")).alias("bucket"))
    counts = seen.groupBy("bucket").agg(
        *[F.count(F.when(F.col("domain") == d, 1)).alias(f"c_{i}") for i, d in enumerate(domains)], F.count("*").alias("c")
    )
    counts = stored(counts, "word-counts")
    sums = counts.agg(*[F.coalesce(F.sum(f"c_{i}"), F.lit(0)) for i in k]).first()
    # a domain without a labelled word gets the share of one word
    whole = sum(max(1, n) for n in sums)
    shares = [max(1, n) / whole for n in sums]
    off = [
        F.abs(F.col(f"c_{i}") - F.col("c") * shares[i]) / F.sqrt(F.col("c") * (shares[i] * (1 - shares[i]) or 1.0)) for i in k
    ]
    telling = (F.col("c") >= LEAST_SEEN) & (F.greatest(*off, F.lit(0.0)) >= TELLING)
    odds = [
        F.log((F.col(f"c_{i}") + PRIOR_SEEN * shares[i]) / (F.col("c") + PRIOR_SEEN) / shares[i]).alias(f"o_{i}") for i in k
    ]
    rest = counts.where(~telling).agg(*[F.coalesce(F.sum(f"c_{i}"), F.lit(0)) for i in k]).first()
    all_rest = sum(rest) + PRIOR_SEEN
    other = [math.log((n + PRIOR_SEEN * q) / all_rest / q) for n, q in zip(rest, shares, strict=True)]
    return counts.where(telling).select("bucket", *odds), other, shares, sum(sums) > 0


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, bool]:
    """key (hash of the text), tokens (words), p_0, p_1, ...: a row for every different text of `docs`; and whether any row was labelled.

    A text without words has the domains' shares for posteriors; without labelled rows all are equal.
    """
    table, other, shares, learned = word_table(labelled, domains)
    table = stored(table, "word-table")
    k = range(len(domains))
    # beside an explode, Spark would take key and tokens from the text once more for every exploded word
    texts = docs.select(
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.size(_words("text")).cast("long").alias("tokens"),
        _kinds("text").alias("kinds"),
    )
    words = texts.select("key", "tokens", F.explode_outer("kinds").alias("bucket"))
    scored = words.join(F.broadcast(table), "bucket", "left")  # bounded rows
    # rows of equal texts add up alike, so their means are those of one; only the weight sees them together
    odds = [F.avg(F.when(F.col("bucket").isNotNull(), F.coalesce(f"o_{i}", F.lit(other[i])))).alias(f"s_{i}") for i in k]
    sums = scored.groupBy("key", "tokens").agg(F.count("bucket").alias("n"), *odds)
    weight = F.least(F.col("n"), F.lit(EVIDENCE))
    sums = sums.withColumns({
        f"s_{i}": F.coalesce(f"s_{i}", F.lit(0.0)) * weight + F.log(F.lit(shares[i])) for i in k
    })
    top = F.greatest(*[F.col(f"s_{i}") for i in k]) if len(domains) > 1 else F.col("s_0")
    raised = sums.withColumns({f"e_{i}": F.exp(F.col(f"s_{i}") - top) for i in k})
    whole = sum((F.col(f"e_{i}") for i in k), F.lit(0.0))
    return raised.select("key", "tokens", *[(F.col(f"e_{i}") / whole).alias(f"p_{i}") for i in k]), learned


#: What a cell carries: its rate, the point where the next gradient is taken, the rate a step earlier, and the point that
#: the last step left.
_STATE = ("rate", "point", "before", "origin")


def _next(k: int, state: str, cell: str, more: str = "") -> str:
    """SQL of the fields `more` and _STATE after a step, given by its residuals and its momentum in `row`.

    SQL texts, not columns: these would be put together call by call.
    """
    pull = " + ".join(f"{cell}b_{i} * row[{i}]" for i in range(k))
    rate = f"greatest(0.0D, {state}.point - ({pull} + {RIDGE!r}D * ({state}.point - 1.0D)) / {1.0 + RIDGE!r}D)"
    # a lambda of its own, as each mention of a rate would compute it anew
    fields = f"r AS rate, r + row[{k}] * (r - {state}.rate) AS point, {state}.rate AS before, {state}.point AS origin"
    return f"transform(array({rate}), r -> struct({more}{fields}))[0]"


def _moved(cells: DataFrame, k: int, steps: list[list[float]]) -> DataFrame:
    """The cells with _state, theirs after the steps; a step is given by its residuals and its momentum."""
    if not steps:
        return cells.selectExpr("*", f"struct({', '.join(_STATE)}) AS _state")
    rows = ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in steps)
    return cells.selectExpr(
        "*", f"aggregate(array({rows}), struct({', '.join(_STATE)}), (s, row) -> {_next(k, 's', '')}) AS _state"
    )


def _stepped(plain: list[str], targets: list[float], own: list[float], tolerance: float) -> str:
    """SQL of cells (an array of the plain columns and _STATE), momentum and settled after HELD_STEPS steps, or fewer where
    one settles them."""
    k = range(len(targets))

    def over(value: str) -> str:
        return f"aggregate(s.cells, 0.0D, (x, c) -> {value})"

    against = over("x + c.tokens * (c.origin - c.rate) * (c.rate - c.before)")
    far = over("greatest(x, abs(c.rate - c.origin))")
    off = ", ".join(f"({over(f'x + c.point * c.m_{i}')} - {float(targets[i])!r}D) / {float(own[i])!r}D" for i in k)
    cell = _next(len(targets), "c", "c.", "".join(f"c.{n} AS {n}, " for n in plain))
    cells = f"transform(array(array({off}, (m - 1) / (m + 2))), row -> transform(s.cells, c -> {cell}))[0]"
    step = f"transform(array(if({against} > 0, 1, s.momentum + 1)), m -> struct({cells} AS cells, m AS momentum, false AS settled))[0]"
    ended = "struct(s.cells AS cells, s.momentum AS momentum, true AS settled)"
    made = f"CASE WHEN s.settled THEN s WHEN s.momentum > 0 AND {far} <= {tolerance!r}D THEN {ended} ELSE {step} END"
    return f"aggregate(sequence(1, {HELD_STEPS}), struct(cells, momentum, settled), (s, i) -> {made})"


def _few_settled(begun: DataFrame, plain: list[str], targets: list[float], own: list[float], tolerance: float) -> DataFrame:
    """The steps within one row of all cells, HELD_STEPS in a job: with a job a step, the driver's memory and time would go
    into hundreds of plans of some hundred cells each."""
    now = begun.coalesce(1).agg(F.collect_list(F.struct(*plain, *_STATE)).alias("cells"))
    now = now.withColumns({"momentum": F.lit(0), "settled": F.lit(False)})
    steps = _stepped(plain, targets, own, tolerance)
    while True:
        now, held = stored(now.selectExpr(f"{steps} AS s").select("s.*"), "cell-steps"), now
        if hasattr(held, "folder"):
            drop_stored(held)
        if now.select("settled").first()[0]:
            return now.selectExpr("inline(cells)").select(*plain, "rate")


def projected_rates(cells: DataFrame, targets: list[float], tolerance: float = TOLERANCE, few: bool = True) -> DataFrame:
    """The rows of a stored table of cells, tokens, m_0, ...: their expected tokens by domain, and b_0, ...: these for a
    token, with their rate.

    Minimises the squared distances of the domains' expected tokens from the targets, each over the domain's own tokens,
    plus RIDGE times that of the rates from 1, over rates of 0 and more.  So measured no curvature is above 1 + RIDGE,
    however small a domain's share, and steps of 1 / (1 + RIDGE) settle.  Momentum grows with the steps and starts anew
    where a step goes against it.  There is no limit of steps: they end where one moves no rate by more than `tolerance`.
    Where the cells are `few`, a job makes HELD_STEPS steps in one row of all cells, and the driver gets whether they have
    settled; else a step is a Spark sum over all cells, and the driver gets a residual a domain.
    """
    k = range(len(targets))
    own = cells.agg(*[F.sum(f"m_{i}") for i in k]).first()
    begun = cells.withColumns({c: F.lit(1.0) for c in _STATE})
    if not any(own):
        return begun.drop(*_STATE[1:])
    plain = [c for c in cells.columns if c != "rate"]
    own, steps, momentum, first = [n or 1.0 for n in own], [], 0, True
    if few:
        return _few_settled(begun, plain, targets, own, tolerance)
    sums = [
        *[f"sum(_state.point * m_{i})" for i in k],
        "sum(tokens * (_state.origin - _state.rate) * (_state.rate - _state.before))", "max(abs(_state.rate - _state.origin))",
    ]
    while True:
        now = _moved(begun, len(targets), steps)
        *got, against, far = now.selectExpr(*sums).first()
        if not first and far <= tolerance:
            return now.selectExpr(*plain, "_state.rate")
        if len(steps) == HELD_STEPS:
            begun, held, steps = stored(now.selectExpr(*plain, "_state.*"), "cell-steps"), begun, []
            if hasattr(held, "folder"):
                drop_stored(held)
        momentum, first = 1 if against > 0 else momentum + 1, False
        steps.append([*[(got[i] - targets[i]) / own[i] for i in k], (momentum - 1) / (momentum + 2)])


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], total: float | None = None
) -> DataFrame:
    """doc_id, key, tokens, a posterior p_<domain> for every domain, and rate, for every row of `docs` (doc_id, text).

    `weights` are the target shares of expected tokens; `total` the tokens to reach, by default as many as the
    domains can give without repeating any.  `labelled` has text and domain.  Tokens are words.  Null text counts as
    empty: its posteriors are the domains' shares.  Without labelled rows all posteriors are
    equal and all rates 1.  Repeated rows count each; an empty table gives no rows.
    """
    domains = list(weights)
    k = range(len(domains))
    by_text, learned = posteriors(docs, labelled, domains)
    by_text = stored(by_text, "posteriors")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    rows = stored(rows.join(by_text, "key"), "memberships")
    drop_stored(by_text)
    grid = [F.round(F.col(f"p_{i}") * CELLS).cast("int").alias(f"g_{i}") for i in k]
    cells = rows.select(*grid, "tokens", *[f"p_{i}" for i in k]).groupBy(*[f"g_{i}" for i in k]).agg(
        F.sum("tokens").alias("tokens"), *[F.sum(F.col("tokens") * F.col(f"p_{i}")).alias(f"m_{i}") for i in k]
    )
    mean = {f"b_{i}": F.when(F.col("tokens") > 0, F.col(f"m_{i}") / F.col("tokens")).otherwise(F.col(f"g_{i}") / CELLS) for i in k}
    cells = stored(cells.withColumns(mean), "cells")  # at most a grid of CELLS + 1 to the domains less one
    counted = cells.limit(BROADCAST_ROWS + 1).count()
    few = counted <= BROADCAST_ROWS
    if few:  # one file for the many small sums
        cells, scattered = stored(cells.coalesce(1), "cells"), cells
        drop_stored(scattered)
    have = cells.agg(*[F.coalesce(F.sum(f"m_{i}"), F.lit(0.0)) for i in k]).first()
    share = [weights[d] / sum(weights.values()) for d in domains]
    if total is None:
        total = min((have[i] / share[i] for i in k if share[i] > 0), default=0.0)
    fitted = projected_rates(cells, [total * s for s in share], few=counted <= ROW_CELLS) if learned else cells.withColumn("rate", F.lit(1.0))
    rated = stored(fitted.select(*[f"g_{i}" for i in k], "rate"), "cell-rates")
    joined = rows.select("*", *grid).join(F.broadcast(rated) if few else rated, [f"g_{i}" for i in k])
    return joined.select("doc_id", "key", "tokens", *[F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


def quality_domains(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """text and domain of labelled documents: toxic, else low where quality is 0, else good; others are left out.

    Of more than `most` labels a share is taken, by a hash of the ids, so that about `most` are left: the
    classifier learns from a bounded sample, and the labels can go to the documents whatever their number.
    """
    toxic, quality = F.col("toxic"), F.col("quality")
    domain = F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")
    known = labels.select(F.col("doc_id").alias("_doc"), domain.alias("domain")).where(
        "_doc IS NOT NULL AND domain IS NOT NULL"
    ).distinct()
    share = min(1.0, most / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64(F.lit("labelled"), "_doc"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_doc")).select("text", "domain")


def draw(mixed: DataFrame) -> Column:
    """Copies of a document at its rate: the whole part, and one more with the chance of the rest, by a hash of its id."""
    chance = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id", "key"), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col("rate") + chance).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], drawn: bool = True, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, as often as `draw` says; without `drawn`, once where the rate is a
    half or more, and not at all below."""
    rated = mixing_rates(docs, labelled, weights, **options)
    copies = draw(rated) if drawn else F.when(F.col("rate") >= 0.5, 1).otherwise(0)
    own, other, times, copy = (free_name(docs, n) for n in ("mixed_id", "mixed_key", "mixed_times", "mixed_copy"))
    changed = rated.select(F.col("doc_id").alias(own), F.col("key").alias(other), copies.alias(times))
    changed = stored(changed.where(F.col(times) != 1).distinct(), "drawn")
    small = changed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = docs.join(
        F.broadcast(changed) if small else changed,
        F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(other)), "left",
    ).withColumn(times, F.coalesce(times, F.lit(1))).where(F.col(times) > 0)
    if drawn:
        joined = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
