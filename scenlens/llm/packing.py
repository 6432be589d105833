"""Best-fit packing of pieces into sequences of a fixed number of tokens.

Pieces of one length are interchangeable, so what is packed is the histogram of lengths:
at most as many numbers as a sequence has tokens, however many documents there are.  The
driver fills it by bin completion and gets a list of patterns (which lengths share a
sequence, and how often).  Every piece then finds its place by its rank among the pieces of its
length, which Spark counts without bringing a length together in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenlens.llm.shared import ready, stored
from scenlens.llm.tokens import ID, encoder

#: Rows of one length that one window partition holds, on average.
RANK_ROWS = 100_000


@dataclass(frozen=True)
class Pattern:
    """Sequences filled alike: (length, copies) from the longest, and how many there are."""

    items: tuple[tuple[int, int], ...]
    count: int

    @property
    def size(self) -> int:
        return sum(n * k for n, k in self.items)


def _pattern(lengths: list[int], count: int) -> Pattern:
    return Pattern(tuple(sorted(Counter(lengths).items(), reverse=True)), count)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Lower bound on the number of sequences: pieces over half are apart, what does not fit beside them is added.

    For every k up to half the capacity: pieces over capacity - k go with none of those from k on; the other
    halves leave their room to the pieces from k to half.  Running sums over the lengths give all k at once.
    """
    n = np.zeros(capacity + 2, np.int64)
    n[list(counts)] = list(counts.values())
    pieces, tokens = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * np.arange(capacity + 2))))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    alone = pieces[capacity + 1] - pieces[capacity - k + 1]
    halves = np.maximum(0, pieces[capacity - k + 1] - pieces[half + 1])
    room = halves * capacity - np.maximum(0, tokens[capacity - k + 1] - tokens[half + 1])
    small = tokens[half + 1] - tokens[k]
    return int(max(-(-tokens[-1] // capacity), (alone + halves + np.maximum(0, -(-(small - room) // capacity))).max()))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: each piece goes where least room is left, else into a new sequence."""
    room: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(left: int, items: tuple[int, ...], count: int) -> None:
        if left not in groups:
            groups[left] = []
            insort(room, left)
        groups[left].append((items, count))

    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            at = bisect_left(room, size)
            if at < len(room):
                left = room[at]
                items, count = groups[left].pop()
                if not groups[left]:
                    del groups[left]
                    room.pop(at)
            else:
                left, items = capacity, ()
                count = max(1, todo // (capacity // size))
            each = min(left // size, todo)
            full = min(count, todo // each)
            put(left - each * size, items + (size,) * each, full)
            if count > full and left != capacity:
                put(left, items, count - full)
            todo -= full * each
    return [_pattern(list(items), n) for left in groups for items, n in groups[left]]


class _Search:
    """Bin completion: the largest remaining piece gets each undominated filling in turn, least waste first."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int, fillings: int, exact_items: int):
        self.capacity, self.nodes, self.fillings, self.exact_items = capacity, nodes, fillings, exact_items
        self.best = best_fit(counts, capacity)
        self.bins = sum(p.count for p in self.best)
        self.bound = least_bins(counts, capacity)
        self.total = sum(n * c for n, c in counts.items())
        self.cut = False
        if self.bins > self.bound:
            self.descend(counts)
        self.proven = self.bins == self.bound or not self.cut

    def completions(self, counts: dict[int, int]) -> list[tuple[int, ...]]:
        """Fillings of the room beside the largest piece, the fullest first.

        Where many pieces remain, fillings of up to three that leave no room are taken if there are any: nothing
        dominates the one of fewest pieces.
        """
        largest = max(counts)
        rest = {n: c - (n == largest) for n, c in counts.items() if c > (n == largest)}
        room = self.capacity - largest
        if sum(counts.values()) > self.exact_items and (found := self.perfect(rest, room)):
            self.cut = True
            return found
        return self.enumerate(rest, room)

    def perfect(self, counts: dict[int, int], room: int) -> list[tuple[int, ...]]:
        """A few fillings of exactly the room, of as few and as large pieces as will do."""
        if not room:
            return [()]
        if room in counts:
            return [(room,)]
        sizes = sorted((n for n in counts if n < room), reverse=True)

        def pair(left: int, below: int, taken: int) -> tuple[int, int] | None:
            for a in sizes[bisect_left(sizes, -min(below, left - 1), key=lambda n: -n) :]:
                b = left - a
                if b > a:
                    return None
                if counts.get(b, 0) - (b == taken) >= 1 + (a == b) and counts[a] - (a == taken) >= 1:
                    return a, b
            return None

        if two := pair(room, room, 0):
            return [two]
        for a in sizes[:40]:
            if two := pair(room - a, a, a):
                return [(a, *two)]
        return []

    def enumerate(self, counts: dict[int, int], room: int) -> list[tuple[int, ...]]:
        """Maximal fillings of the room, undominated, the fullest first."""
        sizes = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
        found: list[tuple[int, ...]] = []

        def grow(i: int, left: int, taken: tuple[int, ...]) -> None:
            if len(found) >= self.fillings:
                self.cut = True
                return
            while i < len(sizes) and sizes[i] > left:
                i += 1
            if i == len(sizes):
                found.append(taken)
                return
            size = sizes[i]
            most = min(counts[size], left // size)
            for k in range(most, -1, -1):
                grow(i + 1, left - k * size, taken + (size,) * k)

        grow(0, room, ())
        free = sorted(n for n, c in counts.items() if c)
        kept = [f for f in found if not self.dominated(f, counts, free, room)]
        return sorted(set(kept), key=lambda f: (-sum(f), len(f)))

    def dominated(self, filling: tuple[int, ...], counts: dict[int, int], free: list[int], room: int) -> bool:
        """A larger remaining piece could stand in for one piece, or a pair of them, and still fit."""
        spare, held = room - sum(filling), Counter(filling)
        sums = set(filling) | {a + b for a, b in combinations(filling, 2)}
        for s in sums:
            at = bisect_left(free, s if s not in held else s + 1)
            while at < len(free) and free[at] <= s + spare:
                if counts[free[at]] > held.get(free[at], 0):
                    return True
                at += 1
        return False

    def child(self, counts: dict[int, int], filling: tuple[int, ...]) -> tuple[dict[int, int], Pattern, int]:
        """What is left after the filling, how it is used, and the room that it wastes."""
        largest = max(counts)
        used = Counter(filling)
        used[largest] += 1
        times = 1
        if sum(counts.values()) > self.exact_items:
            times, self.cut = min(counts[n] // k for n, k in used.items()), True
        left = dict(counts)
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        return left, _pattern([largest, *filling], times), times * (self.capacity - largest - sum(filling))

    def descend(self, counts: dict[int, int]) -> None:
        """Depth first, with a best-fit filling of the rest as a new incumbent now and then, and near the leaves."""
        path: list[Pattern] = []
        stack = [(counts, iter(self.completions(counts)), 0, 0)]
        while stack and self.bins > self.bound:
            counts, fillings, bins, waste = stack[-1]
            filling = next(fillings, None)
            if filling is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            self.nodes -= 1
            if self.nodes < 0:
                self.cut = True
                return
            left, pattern, lost = self.child(counts, filling)
            bins, waste = bins + pattern.count, waste + lost
            if not left:
                if bins < self.bins:
                    self.best, self.bins = [*path, pattern], bins
                continue
            if waste > (self.bins - 1) * self.capacity - self.total or bins + least_bins(left, self.capacity) >= self.bins:
                continue
            if self.nodes % 100 == 0 or len(left) <= 30:
                tail = best_fit(left, self.capacity)
                if bins + sum(p.count for p in tail) < self.bins:
                    self.best, self.bins = [*path, pattern, *tail], bins + sum(p.count for p in tail)
            path.append(pattern)
            stack.append((left, iter(self.completions(left)), bins, waste))


def plan_sequences(
    counts: dict[int, int], capacity: int, nodes: int = 3000, fillings: int = 64, exact_items: int = 40
) -> tuple[list[Pattern], int, bool]:
    """Patterns that use up the histogram, the lower bound, and whether the number of sequences is proven least.

    Best-fit solutions are the incumbents, at the root, at one node in 100 and where 30 lengths or fewer are left.  The
    search ends when the bound is met, all branches are done or `nodes` are spent.  At most `fillings` are tried around
    a piece; above `exact_items` pieces a filling that leaves no room is taken before undominated ones are listed, and
    is repeated as often as its lengths allow.  Every piece is packed either way; these limits can only cost sequences.
    """
    if any(n > capacity or n < 1 for n in counts):
        raise ValueError("a piece does not fit")
    search = _Search({n: c for n, c in counts.items() if c}, capacity, nodes, fillings, exact_items)
    return search.best, search.bound, search.proven


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and the end id (null text: the end id alone).  One longer than the
    capacity is cut into full pieces; its first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([end_id], ID).tobytes()
        for batch in batches:
            row, piece, start, length, sums = [], [], [], [], []
            texts = (text.as_py() for text in batch.column("text"))
            for i, found in enumerate(enc.encode_many(texts)):
                ids = found.tobytes() + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for k, a in enumerate([0, *range(first, n, capacity)]):
                    b = first if a == 0 else a + capacity
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    sums.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    ready(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int, **search) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (`length`, and columns to order by).

    No sequence holds more than `capacity`; its pieces follow each other from offset 0 without gaps.
    Equal rows may be exchanged for each other; nothing else depends on the order of rows.
    """
    spark = ready(pieces.sparkSession)
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}  # at most `capacity` rows
    patterns, _, _ = plan_sequences(counts, capacity, **search)
    # of each length: from which rank on, which pattern's first sequence, its copies there, their first offset
    used: Counter = Counter()
    spans, first = [], 0
    for p in patterns:
        at = 0
        for size, copies in p.items:
            spans.append((size, used[size], first, copies, at))
            used[size] += copies * p.count
            at += size * copies
        first += p.count
    spans.sort()
    table = np.array(spans, np.int64).reshape(-1, 5)
    key = table[:, 0] << np.int64(48) | table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = table[np.searchsorted(key, length << np.int64(48) | rank, side="right") - 1]
        past = rank - row[:, 1]
        return pd.DataFrame({
            "sequence_id": row[:, 2] + past // row[:, 3], "offset": row[:, 4] + past % row[:, 3] * length,
        })

    order = [c for c in pieces.columns if c != "length"]
    sized = spark.createDataFrame(
        [(n, max(1, c // RANK_ROWS)) for n, c in counts.items()], "length long, salts long"
    )  # at most `capacity` rows
    salted = pieces.join(F.broadcast(sized), "length").withColumn(
        "salt", F.pmod(F.xxhash64(*order), F.col("salts"))
    ).drop("salts")
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select(
        "length", "salt",
        F.coalesce(F.sum("n").over(
            Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        ), F.lit(0)).alias("base"),
    )
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)))
    seated = ranked.join(bases, ["length", "salt"]).withColumn("seat", seat("length", F.col("base") + F.col("nth") - 1))
    return seated.select(*pieces.columns, "seat.sequence_id", "seat.offset")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, **search) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens, as few as the search finds.

    Documents without text are one end id; repeated rows and ids, and rows without an id, are packed like others;
    an empty table gives no rows; columns but `doc_id` and `text` are not read.
    """
    return place(stored(pieces_of(docs, vocabulary, end_id, capacity), "pieces"), capacity, **search)
