"""Ranked lexical search as an exact inner-product search over sparse ball trees.

A score is the inner product of an item's vector (occurrences times weight of each of its terms) with a document's (a factor of
occurrences and length).  Only terms of the items can add to it, so a document's vector has these alone.

1. Documents are cut into terms where they lie; a narrow row of the items' terms is written for each, from
   which the numbers of documents and terms of the whole corpus are added up.
2. A task puts its rows into ball trees: nodes with the centre of their documents and a radius that all lie within.
   No document of a node scores more than the item's product with the centre, and the radius times the item's length.
   Radii are taken of the whole vector, twice, with terms scaled by their weight and by its square, and of each term alone, where they add up
   over the item's terms: each bound holds, the smallest is used.
   Whatever rounding does, bounds are only ever made larger.
3. An item searches a tree best bound first and leaves the subtrees whose bound is below its present last place; scores at the
   leaves are sums of 64-bit integers.  What a task has found already bounds its later trees.
4. The tasks' best are merged.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenlens.llm.shared import ready, stored

#: Items, and different terms of all items together, that one pass over the documents looks for, about and at most.
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1 << 17
#: Items whose bounds are worked out together.
GROUP_ITEMS = 64
#: Documents, and entries of their vectors, in a tree.
TREE_ROWS, TREE_ENTRIES = 1 << 14, 1 << 22
LEAF_ROWS = 32
#: Occurrence factors: rises with occurrences towards this.
SCALE = 1_000_000
#: Share that a bound is raised by, far beyond the rounding of its sums.
SAFETY = 1e-9
LENGTH_SHARE = 25

# ASCII letters and digits and whatever is not ASCII (fixed values); in UTF-8 these are single bytes and whole characters alike
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z in lower case."""
    return _TERM.findall((text or "").encode().lower())


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def factors(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each occurrence of a term in a document multiplies the term's weight by."""
    return (1000 * SCALE * times) // (1000 * times + 12 * m)


@dataclass
class Items:
    """A block of items: their ids, and of each the places of its terms in the vocabulary and how often it has them."""

    ids: list[int | None]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: dict[bytes, int]


@dataclass
class Tree:
    """Documents in the order of the leaves: entries (term, factor) of document i from starts[i] on; nodes level by level."""

    ids: np.ndarray
    starts: np.ndarray
    term: np.ndarray
    factor: np.ndarray
    #: Of each node: first document, end, and the numbers of its two halves (-1 for a leaf).
    nodes: np.ndarray
    #: Of each node: the terms its documents have, and of each its mean factor and how far the largest lies above.
    centres: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    radii: np.ndarray


def _take(starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of the documents in another order stand, and their new starts."""
    many = (starts[1:] - starts[:-1])[order]
    new = np.concatenate([[0], np.cumsum(many)])
    return np.repeat(starts[order] - new[:-1], many) + np.arange(new[-1]), new


def grow(ids: np.ndarray, starts: np.ndarray, term: np.ndarray, factor: np.ndarray, weights: np.ndarray) -> Tree:
    """A tree over documents that each have an entry or more; a node is halved by its documents' places between two far ones."""
    scales = weights.astype(np.float64) ** np.array([[1.0], [2.0]])
    nodes, centres, radii = [], [], []
    waiting = [(0, len(ids), -1, 0)]
    while waiting:
        a, b, parent, side = waiting.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        own_term, own = term[starts[a] : starts[b]], factor[starts[a] : starts[b]].astype(np.float64)
        cuts = starts[a:b] - starts[a]
        centre = np.bincount(own_term, own, len(weights)) / (b - a)
        away = []
        for scale in scales:
            squared = scale[own_term] ** 2
            norm = np.add.reduceat(squared * own * own, cuts)
            middle = (scale * centre) @ (scale * centre)
            found = norm - 2 * np.add.reduceat(squared * own * centre[own_term], cuts) + middle
            away.append(np.maximum(found, 0.0) + SAFETY * (norm + middle))
        radii.append([math.sqrt(d.max()) * (1 + SAFETY) for d in away])
        there = np.flatnonzero(centre)
        reach = np.zeros(len(weights))
        np.maximum.at(reach, own_term, own)
        centres.append((there, centre[there], (reach - centre)[there]))
        nodes.append([a, b, -1, -1])
        if b - a <= LEAF_ROWS:
            continue

        def vector(i: int) -> np.ndarray:
            out = np.zeros(len(weights))
            at = slice(starts[a + i] - starts[a], starts[a + i + 1] - starts[a])  # noqa: B023
            out[own_term[at]] = own[at]  # noqa: B023
            return out

        def along(v: np.ndarray) -> np.ndarray:
            return np.add.reduceat(scales[0][own_term] ** 2 * own * v[own_term], cuts)  # noqa: B023

        norm = np.add.reduceat((scales[0][own_term] * own) ** 2, cuts)
        one = vector(int(np.argmax(away[0])))
        other = vector(int(np.argmax(norm - 2 * along(one))))
        order = np.argsort(along(one - other), kind="stable")
        entries, new = _take(starts[a : b + 1] - starts[a], order)
        term[starts[a] : starts[b]], factor[starts[a] : starts[b]] = own_term[entries], factor[starts[a] : starts[b]][entries]
        ids[a:b] = ids[a:b][order]
        starts[a : b + 1] = starts[a] + new
        half = (a + b) // 2
        waiting += [(half, b, len(nodes) - 1, 1), (a, half, len(nodes) - 1, 0)]
    return Tree(ids, starts, term, factor, np.array(nodes), centres, np.array(radii))


def bounds(tree: Tree, wanted: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every node and each of the items (columns of `wanted`, occurrences times weight) what no document below exceeds."""
    long = [np.sqrt(((wanted / weights[:, None] ** p) ** 2).sum(axis=0)) for p in (1.0, 2.0)]
    reach = np.minimum(*(np.outer(tree.radii[:, i], long[i]) for i in (0, 1)))
    own = np.stack([np.stack(pair) @ wanted[at] for at, *pair in tree.centres])
    middle, alone = own[:, 0], own[:, 1]
    return (middle + np.minimum(reach, alone)) * (1 + SAFETY)


class Best:
    """The best documents of an item so far: higher scores first, then smaller ids."""

    def __init__(self, most: int):
        self.most, self.scores, self.ids = most, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """The score below which nothing gets in."""
        return int(self.scores[-1]) if len(self.scores) == self.most else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        in_reach = scores >= self.least
        if in_reach.any():
            scores, ids = np.concatenate([self.scores, scores[in_reach]]), np.concatenate([self.ids, ids[in_reach]])
            order = np.lexsort((ids, -scores))[: self.most]
            self.scores, self.ids = scores[order], ids[order]


def search(tree: Tree, bound: np.ndarray, product: np.ndarray, best: Best) -> int:
    """Visits the leaves that may hold one of an item's best documents; the number of leaves visited."""
    visited, heap = 0, [(-bound[0], 0)]
    while heap:
        top, node = heapq.heappop(heap)
        if -top < best.least:
            break
        a, b, left, right = tree.nodes[node]
        if left < 0:
            lo, hi = tree.starts[a], tree.starts[b]
            scores = np.add.reduceat(product[tree.term[lo:hi]] * tree.factor[lo:hi], tree.starts[a:b] - lo)
            best.add(scores, tree.ids[a:b])
            visited += 1
        else:
            for child in (left, right):
                if bound[child] >= best.least:
                    heapq.heappush(heap, (max(top, -bound[child]), int(child)))
    return visited


NO_ID = np.iinfo(np.int64).max


def _vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (terms of the text), and the items' terms that it holds with their times, for every text with a term."""
    held = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # at most about BLOCK_TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for batch in batches:
            row, many, which, times, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column("text")):
                found = terms(text.as_py())
                if not found:
                    continue
                codes = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
                own, count = np.unique(codes[codes >= 0], return_counts=True)
                row.append(i)
                many.append(len(found))
                which.append(own)
                times.append(count)
                ends.append(ends[-1] + len(own))
            lists = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *v]), pa.int64()).cast(kind))
                for v, kind in ((which, pa.int32()), (times, pa.int64()))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(many, pa.int64()), *lists],
                names=["doc_id", "n", "terms", "times"],
            )

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def _best_of(vectors: DataFrame, items: Items, documents: int, all_terms: int, weights: np.ndarray, most: int) -> DataFrame:
    """place (of the item in its block), doc_id and score: the best of every task."""
    telling = np.flatnonzero(weights > 0)  # a term that all documents hold weighs nothing
    known = np.full(len(weights), -1)
    known[telling] = np.arange(len(telling))
    products = []
    for which, times in zip(items.terms, items.times, strict=True):
        at = known[which]
        products.append((at[at >= 0], (times * weights[which])[at >= 0]))
    held = vectors.sparkSession.sparkContext.broadcast((known, weights[telling], products))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        known, weights, _ = held.value
        parts, rows, entries = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(lo, TREE_ROWS)
                term = known[part.column("terms").flatten().to_numpy()]
                times = part.column("times").flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), part.column("terms").value_lengths().to_numpy())
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * part.column("n").to_numpy() * documents) // all_terms
                factor, kept = factors(times, m[row]), term >= 0
                held_by = np.bincount(row[kept], minlength=part.num_rows)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
                parts.append((ids[held_by > 0], held_by[held_by > 0], term[kept], factor[kept]))
                rows, entries = rows + len(parts[-1][0]), entries + len(parts[-1][2])
                if rows >= TREE_ROWS or entries >= TREE_ENTRIES:
                    yield planted(parts, weights)
                    parts, rows, entries = [], 0, 0
        if rows:
            yield planted(parts, weights)

    def planted(parts: list[tuple], weights: np.ndarray) -> Tree:
        ids, many, term, factor = (np.concatenate(x) for x in zip(*parts, strict=True))
        return grow(ids, np.concatenate([[0], np.cumsum(many)]), term, factor, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, weights, products = held.value
        best = [Best(most) for _ in products]
        for tree in trees(batches):
            for lo in range(0, len(products), GROUP_ITEMS):
                group = products[lo : lo + GROUP_ITEMS]
                wanted = np.zeros((len(weights), len(group)))
                for j, (at, product) in enumerate(group):
                    wanted[at, j] = product
                over = bounds(tree, wanted, weights)
                for j, (at, product) in enumerate(group):
                    dense = np.zeros(len(weights), np.int64)
                    dense[at] = product
                    search(tree, over[:, j], dense, best[lo + j])
        place = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids = np.concatenate([np.empty(0, np.int64), *(b.ids for b in best)])
        scores = np.concatenate([np.empty(0, np.int64), *(b.scores for b in best)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())],
            names=["place", "doc_id", "score"],
        )

    return vectors.mapInArrow(run, "place long, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The different items in blocks whose terms fit the driver; an item without a term asks for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                names=["item_id", "terms", "times"],
            )

    kept = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = stored(kept.mapInArrow(run, "item_id long, terms array<binary>, times array<long>").where("size(terms) > 0"), "items")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(-(-size["n"] // BLOCK_ITEMS), -(-size["terms"] // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(1, blocks)))
    for b in range(blocks):
        got = rows.where(block == b).toArrow().to_pydict()
        vocabulary: dict[bytes, int] = {}
        which = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in own], np.int64) for own in got["terms"]]
        if which:
            yield Items(got["item_id"], which, [np.array(t, np.int64) for t in got["times"]], vocabulary)


def rank(docs: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score of the `most` best documents (doc_id, text) of every item (item_id, text).

    Only scores above 0 count; equal scores stand by ascending doc_id, without an id last, and repeated rows of
    documents each have a place.  Equal rows of items are one item; rows of one id with different texts are
    ranked apart.  Null texts and texts without a term match nothing; an empty table gives no rows; other columns are not read.
    """
    spark = ready(docs.sparkSession)
    out = None
    for block in _blocks(items):
        vectors = stored(_vectors(docs, block), "vectors")
        documents, all_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = np.zeros(len(block.vocabulary), np.int64)
        # at most as many rows as the block has terms
        for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holding[term] = n
        weights = np.array([weight(documents, int(h)) for h in holding], np.int64)
        found = _best_of(vectors, block, documents, all_terms, weights, most)
        names = spark.createDataFrame(list(enumerate(block.ids)), "place long, item_id long")
        nth = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        placed = found.withColumn("rank", nth).where(F.col("rank") <= most).join(F.broadcast(names), "place")
        placed = placed.select("item_id", "rank", "doc_id", "score")
        out = placed if out is None else out.unionByName(placed)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
