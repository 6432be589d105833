"""Language of texts by a linear-chain conditional random field over their words.

A word's features are its lexicon entry, affixes and character n-grams, hashed into one weight table;
learned transitions tie neighbouring words.  Training sentences are spliced from documents of several languages, so
the field learns where code switches.  The driver fits it on a bounded sample; every text is then labelled whole,
word by word, with forward-backward, and the mean of its words' posteriors gives its language.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as dataclass_field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenlens.llm.shared import ready

FEATURES = 1 << 16
#: Words that one chain holds; a longer text is several chains.
CHAIN = 64
SAMPLE_DOCS = 300
SAMPLE_CHAINS = 6000
UNKNOWN = "und"
_MAX_WORDS = 200_000
_MAX_TOKENS = 300_000
#: Tokens that are looked up and labelled together.
_AT_ONCE = 50_000


def normal(token: str) -> str:
    """The token in lower case without what is not a letter at its ends; empty if it has no letter."""
    token = token.lower()
    if token.isalpha():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return token[a:b]


_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Letters of a word; a longer run of letters is several words of the chain.
_LONGEST = 40
_POWERS = np.cumprod(np.full(_LONGEST + 2, _P[0]), dtype=np.uint64)


def pieces(tokens: list[str]) -> list[str]:
    """The tokens, those whose word is too long for one in parts that together hold all of it: split where no letter is,
    and a run of letters (with the marks on them) that is still too long every _LONGEST characters."""
    # a letter's lower case has two characters at most
    if not any(len(t) > _LONGEST // 2 for t in tokens):
        return tokens
    out: list[str] = []
    for token in tokens:
        if len(token) <= _LONGEST // 2 or len(normal(token)) <= _LONGEST:
            out.append(token)
            continue
        spaced = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in token.lower())
        for run in spaced.split():
            out += [run[i : i + _LONGEST] for i in range(0, len(run), _LONGEST)]
    return out


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    """Weight row of a feature: a mixing of its value, another for each kind of feature."""
    x = (x + np.uint64(kind)) * _P[3]
    return ((x ^ (x >> np.uint64(32))) * _P[2] >> np.uint64(48)).astype(np.int64) % FEATURES


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the features of some words, and the word that each belongs to.

    Lexicon entry, first and last one to three letters, n-grams of two and three letters with the word's edges.
    A word has at most _LONGEST letters, as those of `pieces` have.
    """
    c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    place, left = np.arange(len(c)) - starts[owner], ends[owner] - np.arange(len(c))
    with np.errstate(over="ignore"):
        two = c[:-1] * _P[0] + c[1:] * _P[1]
        three = two[:-1] + c[2:] * _P[2]
        found = [
            (_slot(two, 2)[left[:-1] > 1], owner[:-1][left[:-1] > 1]), (_slot(three, 3)[left[:-2] > 2], owner[:-2][left[:-2] > 2]),
            (_slot(np.add.reduceat(c * _POWERS[place], starts), 1), np.arange(len(words))),
        ]
        for k in (1, 2, 3):
            has = np.flatnonzero(sizes - 2 >= k)
            for kind, first in ((3 + k, starts[has] + 1), (6 + k, ends[has] - 1 - k)):
                x = sum((c[first + i] * _P[i] for i in range(k)), np.zeros(len(has), np.uint64))
                found.append((_slot(x, kind), has))
    return np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found])


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # features x labels
    first: np.ndarray
    moves: np.ndarray  # from x to
    token: str = dataclass_field(default_factory=lambda: uuid.uuid4().hex)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the labels for each word, by its features alone."""
        if not words:
            return np.empty((0, len(self.labels)))
        rows, owner = features(words)
        size = np.bincount(owner, minlength=len(words))
        sums = [np.bincount(owner, self.weights[rows, k], len(words)) for k in range(len(self.labels))]
        return np.stack(sums, axis=1) / np.sqrt(size)[:, None]

    def posteriors(self, scores: np.ndarray, mask: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward on chains x words x labels: word posteriors, and expected moves over all chains if asked to `count`.

        The mask holds words; they come first in a chain.
        """
        chains, steps, k = scores.shape
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        move, start = np.exp(self.moves), np.exp(self.first)
        ahead, scale = np.empty_like(local), np.empty((chains, steps, 1))
        a = start * local[:, 0]
        for t in range(steps):
            if t:
                a = np.where(mask[:, t, None], (a @ move) * local[:, t], a)
            scale[:, t] = a.sum(axis=1, keepdims=True)
            a = a / scale[:, t]
            ahead[:, t] = a
        back = np.ones((chains, k))
        out, moved = np.empty_like(local), np.zeros((k, k))
        out[:, -1] = ahead[:, -1]
        for t in range(steps - 1, 0, -1):
            here = mask[:, t, None]
            toward = local[:, t] * back / scale[:, t]
            if count:
                moved += (ahead[:, t - 1] * here).T @ toward * move
            back = np.where(here, toward @ move.T, back)
            out[:, t - 1] = ahead[:, t - 1] * back
        return out / out.sum(axis=2, keepdims=True), moved


def spliced(texts: dict[str, list[list[str]]], chains: int, rng: np.random.Generator) -> Iterator[list[tuple[str, int]]]:
    """Chains of words with labels, cut from documents; some switch language on the way."""
    labels = sorted(texts)
    for _ in range(chains):
        chain: list[tuple[str, int]] = []
        k = int(rng.integers(len(labels)))
        while len(chain) < CHAIN:
            words = texts[labels[k]][int(rng.integers(len(texts[labels[k]])))]
            n = int(rng.integers(8, CHAIN + 1))
            at = int(rng.integers(max(1, len(words) - n + 1)))
            chain += [(w, k) for w in words[at : at + n]]
            k = int(rng.integers(len(labels)))
        yield chain[:CHAIN]


def fit_field(texts: dict[str, list[list[str]]], chains: int = SAMPLE_CHAINS, passes: int = 2, seed: int = 7) -> Field:
    """Maximises the likelihood of spliced chains by adaptive gradient steps, on the driver."""
    labels, rng = sorted(texts), np.random.default_rng(seed)
    k = len(labels)
    field = Field(labels, np.zeros((FEATURES, k)), np.zeros(k), np.zeros((k, k)))
    data = list(spliced(texts, chains, rng))
    known: dict[str, int] = {}
    for chain in data:
        for w, _ in chain:
            known.setdefault(w, len(known))
    lexicon = list(known)
    x = np.array([[known[w] for w, _ in c] for c in data])
    y = np.array([[label for _, label in c] for c in data])
    squares = [np.full(p.shape, 1e-6) for p in (field.weights, field.first, field.moves)]
    for _ in range(passes):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            some = order[lo : lo + 64]
            words, at = np.unique(x[some], return_inverse=True)
            flat, owner = features([lexicon[w] for w in words])
            scaled = 1.0 / np.sqrt(np.bincount(owner, minlength=len(words)))
            table = np.zeros((len(words), k))
            np.add.at(table, owner, field.weights[flat])
            table *= scaled[:, None]
            at = at.reshape(len(some), CHAIN)
            mask = np.ones(at.shape, bool)
            post, moved = field.posteriors(table[at], mask)
            truth = np.eye(k)[y[some]]
            by_word = np.zeros((len(words), k))
            np.add.at(by_word, at.ravel(), (truth - post).reshape(-1, k))
            grads = [
                np.zeros_like(field.weights), (truth[:, 0] - post[:, 0]).sum(0),
                np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - moved,
            ]
            np.add.at(grads[0], flat, (by_word * scaled[:, None])[owner])
            for p, g, s in zip((field.weights, field.first, field.moves), grads, squares, strict=True):
                s += g**2
                p += 0.3 * g / np.sqrt(s)
    return field


class _Labeller:
    """Looks words up by number; forgets them all when there are too many."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.tokens: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.table = np.empty((1024, len(self.field.labels)))

    def learn(self, tokens: list[str]) -> None:
        fresh = []
        for token in tokens:
            word = normal(token)
            if not word:
                self.tokens[token] = -1
                continue
            if word not in self.words:
                self.words[word] = len(self.words)
                fresh.append(word)
            self.tokens[token] = self.words[word]
        if fresh:
            while len(self.words) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[len(self.words) - len(fresh) : len(self.words)] = self.field.emissions(fresh)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """Numbers of the tokens' words, -1 for those without a letter."""
        if len(self.tokens) > _MAX_TOKENS or len(self.words) > _MAX_WORDS:
            self.forget()
        try:
            return np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            self.learn([t for t in dict.fromkeys(tokens) if t not in self.tokens])
            return np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words and the sums of their posteriors, text by text."""
        count, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.field.labels)))
        tokens: list[str] = []
        owner: list[int] = []
        sizes: list[int] = []
        for i, text in enumerate(texts):
            if text:
                found = pieces(text.split())
                tokens += found
                owner.append(i)
                sizes.append(len(found))
            if len(tokens) > _AT_ONCE or i == len(texts) - 1:
                self.chains(np.repeat(owner, sizes), self.numbers(tokens), count, sums)
                tokens, owner, sizes = [], [], []
        return count, sums

    def chains(self, owner: np.ndarray, at: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
        """Adds the words `at`, of the texts `owner`, to the texts' counts and sums."""
        owner, at = owner[at >= 0], at[at >= 0]
        if not len(at):
            return
        texts, first, size = np.unique(owner, return_index=True, return_counts=True)
        count[texts] = size
        rows = -(-size // CHAIN)
        place = np.arange(len(at)) - np.repeat(first, size)
        grid = np.full((rows.sum(), CHAIN), -1)
        grid[np.repeat(np.cumsum(rows) - rows, size) + place // CHAIN, place % CHAIN] = at
        of = np.repeat(texts, rows)
        for lo in range(0, len(grid), 1024):
            part = grid[lo : lo + 1024]
            mask = part >= 0
            post, _ = self.field.posteriors(self.table[part] * mask[:, :, None], mask, count=False)
            np.add.at(sums, of[lo : lo + 1024], (post * mask[:, :, None]).sum(axis=1))


_LABELLERS: dict[str, _Labeller] = {}


def _labeller(field: Field) -> _Labeller:
    """This process's labeller of the field; what it has learnt of words serves all tasks that the process runs."""
    if field.token not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[field.token] = _Labeller(field)
    return _LABELLERS[field.token]


def label_texts(docs: DataFrame, field: Field | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score and n_words of every row's whole text.

    Words stand between white space; one of more than _LONGEST letters counts as the several words of its `pieces`.
    The score is the language's share of the words' posterior mass.  `und` with score 0 where the text is
    null or has no letter, and everywhere if there is no field.
    """
    spark = ready(docs.sparkSession)
    sent = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(sent.value) if sent.value else None
        for batch in batches:
            n = batch.num_rows
            count, best, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            if labeller and n:
                count, sums = labeller.label(batch.column(1).to_pylist())
                share = sums / np.maximum(count, 1)[:, None]
                best, score = share.argmax(axis=1), np.clip(share.max(axis=1), 0.0, 1.0)
            names = [labeller.field.labels[b] if c else UNKNOWN for b, c in zip(best, count, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score * (count > 0), pa.float64()), pa.array(count)],
                names=["doc_id", "lang_pred", "score", "n_words"],
            )

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, lang_pred string, score double, n_words long")


def train(
    docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, **options
) -> Field | None:
    """A field from the rows of `docs`, at most `sample_docs` of each language, picked by a hash of id and text.

    Rows without language or text are passed over; null if no row with a word is left.
    """
    some = docs.select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text, doc_id).alias("h")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return None
    # a share of each language by hash first, so that what meets in the window is a few times the sample
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 4.0 * sample_docs / n)))])
    some = some.where(F.pmod(F.col("h"), F.lit(1 << 30)) <= share[F.col("lang")] * float(1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    texts: dict[str, list[list[str]]] = {}
    for row in some.withColumn("nth", nth).where(F.col("nth") <= sample_docs).select("lang", "text").toLocalIterator():
        words = [w for w in map(normal, pieces(row["text"].split())) if w]
        if words:
            texts.setdefault(row["lang"], []).append(words)
    return fit_field({k: sorted(v) for k, v in texts.items()}, **options) if texts else None


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
