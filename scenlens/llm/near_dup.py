"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

1. A document's set holds the hashes of its shingles; one hash function serves sets and sketches.  The `SKETCH`
   smallest values are its sketch.  Equal sets are one class from here on.
2. Every retained value has a list of the classes that retain it.  Two classes that share `OVERLAP`
   values or more share one among their rarest, so a class enters the lists of its rarest values only:
   all but OVERLAP - 1.  A passage that thousands share then rarely has a list.
3. Within a list the sketch of the union of two sets estimates their similarity; pairs over the bound make
   candidate clusters.  A long list is dealt out in blocks, and a task compares two blocks.
4. Within a cluster, again in blocks, the full sets are compared and links confirmed exactly.
5. Components of the links.  A block returns links that span what it found, not all pairs.

A link of similarity s = 0.75 is missed when two sketches share fewer than 28 of 64 values, 48 of which are
expected to be common (5.8 standard deviations); sets of at most 48 shingles are compared without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens.llm.components import components
from scenlens.llm.shared import free_name, ready, stored

SKETCH = 64
OVERLAP = 28
WORDS = 5
BLOCK = 1024
BLOCK_SHINGLES = 300_000
BROADCAST_ROWS = 200_000
#: Groups of up to so many rows are compared pair by pair, larger ones by a matrix product.
SMALL = 16

_PAD = np.uint32(0xFFFFFFFF)
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z in lower case; empty without words."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(w))
    with np.errstate(over="ignore"):
        x = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            x = (x ^ (x >> np.uint64(29))) * _ODD[i % 5] + w[i : len(w) - size + 1 + i]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique(x ^ (x >> np.uint64(33)))


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n, h1, h2 (the identity of the set) and sketch: its smallest values' upper halves, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, sketches = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), words)
                sizes.append(len(s))
                first.append(xxhash.xxh64_intdigest(s.tobytes(), 0))
                second.append(xxhash.xxh64_intdigest(s.tobytes(), 1))
                sketches.append((s[:SKETCH] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(np.array(first, np.uint64).view(np.int64)),
                 pa.array(np.array(second, np.uint64).view(np.int64)), pa.array(sketches, pa.list_(pa.int32()))],
                names=["doc_id", "text_hash", "n", "h1", "h2", "sketch"],
            )

    text = F.col("text").cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return kept.mapInArrow(run, "doc_id long, text_hash long, n long, h1 long, h2 long, sketch array<int>")


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by the keys, cut where all rows of a key are at hand: frames of whole groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        same = (batch[keys] == last).all(axis=1).to_numpy()
        cut = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0
        if held and (cut or not (held[-1][keys].iloc[-1] == last).all()):
            held.append(batch.iloc[:cut])
            yield pd.concat(held)
            held = []
        elif cut:
            yield batch.iloc[:cut]
        if cut < len(batch):
            held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held)


def runs(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where each group of the keys begins, and the end."""
    change = np.zeros(len(frame), bool)
    for k in keys:
        v = frame[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.concatenate(([0], np.flatnonzero(change), [len(frame)]))


def spanning(linked: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, for every row the first row it can reach."""
    label = np.arange(len(linked))
    while True:
        best = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, best)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of indicator matrices of shared values."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    out = np.zeros((len(rows), len(rows)), np.float64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((len(rows), 4096), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def union_estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches, padded rows: the shared part of the smallest values of their union."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    twin = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    fresh = both != _PAD
    fresh[:, 1:] &= ~twin
    nth = np.cumsum(fresh, axis=1)
    shared = (twin & (nth[:, 1:] <= SKETCH)).sum(axis=1)
    return shared / np.maximum(1, np.minimum(SKETCH, nth[:, -1]))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of lists whose pairs pass the estimate: (a, b), spanning what a long list's blocks link."""
    keys = ["value", "i", "j"]
    for frame in groups(batches, keys):
        starts = runs(frame, keys)
        node = frame["node"].to_numpy()
        sketches = np.full((len(frame), SKETCH), _PAD, np.uint32)
        for r, s in enumerate(frame["sketch"].to_numpy()):
            sketches[r, : len(s)] = np.asarray(s, np.int32).view(np.uint32)
        sizes = np.diff(starts)
        found = []
        little = np.repeat(sizes <= SMALL, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        pairs = []
        for d in range(1, SMALL):
            at = np.flatnonzero(little[:-d] & (group[:-d] == group[d:])) if len(frame) > d else np.empty(0, np.int64)
            pairs.append(np.stack([at, at + d], axis=1))
        at = np.concatenate(pairs)
        if len(at):
            named = np.sort(node[at], axis=1)
            _, first = np.unique(named, axis=0, return_index=True)
            for lo in range(0, len(first), 4096):
                some = at[first[lo : lo + 4096]]
                good = union_estimates(sketches[some[:, 0]], sketches[some[:, 1]]) >= OVERLAP / SKETCH
                found.append(node[some[good]])
        for g in np.flatnonzero(sizes > SMALL):
            a, b = starts[g], starts[g + 1]
            rows = [s[s != _PAD] for s in sketches[a:b]]
            # the shared retained values bound the shared part of the union's sketch from above
            need = np.minimum(OVERLAP, np.ceil(0.44 * np.array([len(r) for r in rows])))
            label = spanning(overlaps(rows) >= np.minimum(need[:, None], need[None, :]))
            far = np.flatnonzero(label != np.arange(len(label)))
            found.append(np.stack([node[a + far], node[a + label[far]]], axis=1))
        for links in found:
            if len(links):
                yield pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def _links(similarity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Confirmed links of clusters, spanning what two blocks link."""
        keys = ["cluster", "i", "j"]
        for frame in groups(batches, keys):
            starts, node = runs(frame, keys), frame["node"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in frame["members"]]
            found = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                some = sets[a:b]
                size = np.array([len(s) for s in some])
                if b - a == 2:
                    shared = len(np.intersect1d(some[0], some[1], assume_unique=True))
                    both = np.array([[size[0], shared], [shared, size[1]]])
                else:
                    both = overlaps(some)
                union = size[:, None] + size[None, :] - both
                label = spanning(100 * both >= similarity * union)
                far = np.flatnonzero(label != np.arange(len(label)))
                found.append(np.stack([node[a + far], node[a + label[far]]], axis=1))
            found = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            if len(found):
                yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return run


def _dealt(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Every row in its block of the key, once for each pair of blocks (i <= j) that it belongs to."""
    block = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    return (
        df.withColumn("_blocks", blocks.cast("long")).withColumn("_block", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .withColumn("i", F.least("_block", "_other")).withColumn("j", F.greatest("_block", "_other"))
        .drop("_blocks", "_block", "_other").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
    )


def near_duplicates(docs: DataFrame, similarity: int = 75, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    Documents are linked where 100 * intersection >= `similarity` * union of their sets of `words`-word
    shingles (75 or more); a shorter text is one shingle.  component_id is the smallest id that links lead to, itself
    included; kept holds where it is the row's own id.  Texts that are null or have no word are linked with
    nothing.  Rows of one id are documents of their own and may link each other.  A row without an id is its own
    component, null, and kept.  An empty table gives no rows; other columns are not read.
    """
    return _decided(docs, similarity, words).drop("text_hash")


def _decided(docs: DataFrame, similarity: int = 75, words: int = WORDS) -> DataFrame:
    """`near_duplicates` beside the hash of each row's text."""
    if similarity < 75:
        raise ValueError("sketches are laid out for a similarity of 75 or more")
    ready(docs.sparkSession)
    rows = stored(sketched(docs, words), "sketches")
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = stored(
        named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()), "classes",
    )
    postings = classes.select("node", F.explode("sketch").alias("value"))
    common = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    # a class's values that others retain, rarest first; values of its own are rarer still
    shared = postings.join(common, "value").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared")
    )
    need = F.when(F.col("n") <= SKETCH * 3 // 4, F.ceil(F.col("n") * 0.75)).otherwise(OVERLAP)
    entered = shared.join(classes.select("node", "n", "sketch"), "node").select(
        "node", "sketch", F.explode(F.slice(
            "shared", 1, F.greatest(F.lit(0), F.size("shared") - need + 1).cast("int")
        )).alias("entry"),
    ).select("node", "sketch", "entry.value")
    entered = stored(entered, "lists")
    lists = entered.groupBy("value").agg(F.count("*").alias("m")).where("m > 1")
    listed = entered.join(lists, "value")
    dealt = _dealt(listed, "value", F.ceil(F.col("m") / BLOCK)).select("value", "i", "j", "node", "sketch")
    candidates = dealt.mapInPandas(_candidates, "a long, b long").distinct()
    clusters = stored(components(candidates).withColumnRenamed("label", "cluster"), "clusters")

    wanted = clusters.join(classes.select("node", "rep", "n", "h1", "h2"), "node")
    weights = wanted.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("weight"))
    wanted = stored(wanted.join(weights, "cluster"), "wanted")
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(wanted) if small else wanted, "rep")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sets = [], []
            for i, (text, h1, h2) in enumerate(zip(*(batch.column(c) for c in ("text", "h1", "h2")), strict=True)):
                members = shingle_set(text.as_py(), words).tobytes()
                if (np.uint64(xxhash.xxh64_intdigest(members, 0)).view(np.int64) == h1.as_py()
                        and np.uint64(xxhash.xxh64_intdigest(members, 1)).view(np.int64) == h2.as_py()):
                    keep.append(i)
                    sets.append(members)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in ("cluster", "node", "m", "weight")), pa.array(sets, pa.binary())],
                names=["cluster", "node", "m", "weight", "members"],
            )

    sets = found.mapInArrow(with_sets, "cluster long, node long, m long, weight long, members binary")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    dealt = _dealt(sets, "cluster", blocks).select("cluster", "i", "j", "node", "members")
    links = dealt.mapInPandas(_links(similarity), "a long, b long").distinct()
    joined = components(links)
    reached = joined.join(classes.select("node", "rep"), "node")
    smallest = reached.groupBy("label").agg(F.min("rep").alias("component"))
    by_class = classes.select("node", "h1", "h2", "rep").join(
        joined.join(smallest, "label").select("node", "component"), "node", "left"
    ).select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    by_class = by_class.withColumn("linkable", F.lit(True))
    out = rows.select("doc_id", "text_hash", "n", "h1", "h2", (F.col("doc_id").isNotNull() & (F.col("n") > 0)).alias("linkable")).join(
        by_class, ["h1", "h2", "linkable"], "left"
    )
    component = F.coalesce("component", "doc_id")
    component = F.when(F.col("linkable"), component).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash",
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stand for their component, with all their columns.

    A row goes by its id and its text: another row of the id, with another text, is judged for itself.  Of rows that
    share the smallest id of a component, all stay.
    """
    own, other = free_name(docs, "duplicate_id"), free_name(docs, "duplicate_text")
    gone = _decided(docs, **options).where(~F.col("kept")).select(
        F.col("doc_id").alias(own), F.col("text_hash").alias(other)
    ).distinct()
    gone = stored(gone, "duplicates")
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    same = (F.col("doc_id") == F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(other))
    return docs.join(F.broadcast(gone) if small else gone, same, "left_anti")
