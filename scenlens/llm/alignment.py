"""Aligns the tokens of two tokenizers on the bytes of a text, by pointer jumping.

Both tokenizers cut the same bytes, so their tokens overlap in a chain of groups that end where a token of each ends.  Every
token points to the token that reaches farthest right among those it overlaps, of two that reach equally far to
the first tokenizer's.  Replacing every pointer by the pointer's pointer, for all tokens of a batch at once, doubles the
steps; after as many rounds as the longest chain has bits, each token holds its group's last token, which is the group's label.

1. Texts are encoded and aligned where they lie; a row of numbers is written per document, with the different pairs
   of ids that end together and how often.
2. Pairs are added up over the corpus and written as sharded files of sorted keys: no document joins them.
3. Documents look their pairs up in the mapped shards.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens.llm.shared import drop_stored, new_folder, ready, stored
from scenlens.llm.token_files import file_system, read_array
from scenlens.llm.tokens import LETTERS, encoder

#: Pairs of ids in a shard of the counts, about: 17 bytes each.
SHARD_PAIRS = 1 << 20
CHUNK_CHARS = 1 << 20
LOOKUP_ROWS = 1024


def last_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of either side, the number of the first side's token that ends its group.

    The ends are ascending offsets into the same bytes; tokens begin where their predecessors end, and both sides end together.
    """
    n = len(ends_a)
    begins_a, begins_b = np.r_[0, ends_a[:-1]], np.r_[0, ends_b[:-1]]
    # the token of the other side that covers the last byte reaches farthest right
    over_a = np.searchsorted(begins_b, ends_a, side="left") - 1
    over_b = np.searchsorted(begins_a, ends_b, side="left") - 1
    to = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])
    while True:
        farther = to[to]
        if (farther == to).all():
            return to[:n], to[n:]
        to = farther


class Aligner:
    """The two tokenizers of a process."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.first = encoder(byte_vocabulary, True)
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        back = {ord(letter): b for b, letter in LETTERS.items()}
        vocabulary = self.first.library.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            letters = token.translate(back)
            self.bytes_a[i] = letters.encode("latin-1") if all(ord(c) < 256 for c in letters) else token.encode()
        piece = self.second.id_to_piece
        self.bytes_b = [
            bytes([int(piece(i)[3:5], 16)]) if self.second.is_byte(i) else piece(i).replace("▁", " ").encode()
            for i in range(self.second.get_piece_size())
        ]
        self.size_a, self.size_b = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        names_a, names_b = range(len(self.bytes_a)), range(len(self.bytes_b))
        self.printed = [
            *(f"{i}," for i in names_a), *(f"{i}|" for i in names_a), *(f"{i}," for i in names_b), *(f"{i};" for i in names_b)
        ]

    @property
    def base(self) -> int:
        """A pair of ids is one number: the first times this, and the second."""
        return len(self.bytes_b)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both tokenizers, none where a text is empty or either does not give its bytes back."""
        none = np.empty(0, np.int64)
        spaced = [f" {t}" if t else None for t in texts]
        second = iter(self.second.encode([t for t in texts if t], num_threads=1))
        for text, a in zip(spaced, self.first.encode_many(spaced), strict=True):
            if text is None:
                yield none, none
                continue
            b, whole = next(second), text.encode()
            if b"".join(map(self.bytes_b.__getitem__, b)) != whole or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole:
                yield none, none
            else:
                yield a.astype(np.int64), np.array(b, np.int64)

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """Of every text: tokens of each side, groups, their digest, and the different linked pairs with their times."""
        found = list(self.tokens(texts))
        many_a, many_b = (np.array([len(x[i]) for x in found], np.int64) for i in (0, 1))
        a, b = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        if len(a):
            # the documents' bytes one after another: both sides end together wherever a document does
            ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            label_a, label_b = last_tokens(ends_a, ends_b)
            last_a = label_a == np.arange(len(a))
            last_b = np.r_[label_b[1:] != label_b[:-1], True]
            group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
            before_a = np.searchsorted(group_b, group_a, side="left")  # tokens of the other side in earlier groups
            before_b = np.searchsorted(group_a, group_b, side="right")
            shown = np.empty(len(a) + len(b), np.int64)
            shown[np.arange(len(a)) + before_a] = a + np.where(last_a, len(self.bytes_a), 0)
            shown[np.arange(len(b)) + before_b] = 2 * len(self.bytes_a) + b + np.where(last_b, len(self.bytes_b), 0)
            links = a[last_a] * self.base + b[last_b]
            upto = np.cumsum(np.r_[0, last_a])
        at_a, at_b = np.cumsum(np.r_[0, many_a]), np.cumsum(np.r_[0, many_b])
        for i in range(len(found)):
            if not many_a[i]:
                yield 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
                continue
            text = "".join(map(self.printed.__getitem__, shown[at_a[i] + at_b[i] : at_a[i + 1] + at_b[i + 1]].tolist()))
            own = links[upto[at_a[i]] : upto[at_a[i + 1]]]
            pairs, times = np.unique(own, return_counts=True)
            yield int(many_a[i]), int(many_b[i]), len(own), hashlib.sha256(text[:-1].encode()).hexdigest(), pairs, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
_LOCK = threading.Lock()


def aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    """This process's tokenizers; one set serves all tasks that the process runs."""
    with _LOCK:
        if (byte_vocabulary, piece_model) not in _ALIGNERS:
            _ALIGNERS[byte_vocabulary, piece_model] = Aligner(byte_vocabulary, piece_model)
        return _ALIGNERS[byte_vocabulary, piece_model]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]).astype(np.int64)))


def aligned(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, and the linked pairs of ids with their times, for every row of `docs`.

    A group is the tokens between two offsets where tokens of both sides end; its two last tokens are a link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_vocabulary, piece_model)
        for batch in batches:
            lo, held, size = 0, [], 0
            for i, text in enumerate(batch.column("text")):
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size < CHUNK_CHARS and i + 1 < batch.num_rows:
                    continue
                rows = list(both.align(held))
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(held)), *numbers, pa.array([r[3] for r in rows], pa.string()),
                     _lists([r[4] for r in rows]), _lists([r[5] for r in rows])],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
                )
                lo, held, size = i + 1, [], 0

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
    )


def pair_counts(rows: DataFrame, base: int) -> DataFrame:
    """pair, n and best of every pair of ids that is linked anywhere in `rows` (pairs, times): how many links hold it, and
    whether no pair with its second id has more."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("link.pairs", "link.times")
    counts = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair-counts")
    most = counts.groupBy((F.col("pair") % base).alias("second")).agg(F.max("n").alias("most"))  # at most `base` rows
    joined = counts.join(F.broadcast(most), F.col("pair") % base == F.col("second"))
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def write_counts(counts: DataFrame, shards: int) -> tuple[str, list[list[str]]]:
    """Writes sorted arrays of pairs, their numbers and marks; the folder, and the names of each shard's files.

    A task writes under names of its own and reports them when it is done, so a repeated task does no harm.
    """
    spark = counts.sparkSession
    folder = new_folder(spark, "pair-shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema)  # one task's shards, SHARD_PAIRS rows each
        if not held.num_rows:
            return
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        shard, names = held.column("shard").to_numpy(), []
        for s in np.unique(shard).tolist():
            at, name = np.flatnonzero(shard == s), f"{s}-{uuid.uuid4().hex}"
            for kind, dtype in (("pair", "<i8"), ("n", "<i8"), ("best", "u1")):
                with fs.open_output_stream(f"{path}/{name}.{kind}") as f:
                    f.write(held.column(kind).to_numpy()[at].astype(dtype).tobytes())
            names.append((s, name))
        yield pa.RecordBatch.from_pydict({"shard": [s for s, _ in names], "name": [n for _, n in names]})

    schema = pa.schema([("shard", pa.int64()), ("pair", pa.int64()), ("n", pa.int64()), ("best", pa.bool_())])
    dealt = counts.select((F.col("pair") % shards).alias("shard"), "pair", "n", "best")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "pair")
    written = stored(dealt.mapInArrow(run, "shard long, name string"), "pair-shard-names")
    names: list[list[str]] = [[] for _ in range(shards)]
    for r in written.collect():  # a row a shard
        names[r["shard"]].append(r["name"])
    return folder, names


@lru_cache(maxsize=8)
def _shard(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(read_array(folder, f"{name}.{kind}", dtype) for kind, dtype in (("pair", "<i8"), ("n", "<i8"), ("best", "u1")))


def look_up(pairs: np.ndarray, folder: str, names: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """How often each pair is linked, and whether no other has more for its second id; every pair is in a shard."""
    different, back = np.unique(pairs, return_inverse=True)
    n, best = np.zeros(len(different), np.int64), np.zeros(len(different), bool)
    shard = different % len(names)
    for s, own in enumerate(names):
        at = np.flatnonzero(shard == s)
        for name in own if len(at) else ():
            keys, many, marks = _shard(folder, name)
            place = np.searchsorted(keys, different[at])
            n[at], best[at] = many[place], marks[place] == 1
    return n[back], best[back]


def cross_tokenizer_alignment(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of `docs` (doc_id, text).

    n_best are the links whose pair no other pair with the same second id surpasses in the corpus; count_sum adds up the
    corpus-wide counts of the links.  Texts are cut after a space is put before them.  A text that is null or
    empty, or that a tokenizer does not give back byte by byte, has no tokens: zeros and an empty digest.  Repeated rows
    count each; ids may be null or repeated; an empty table gives no rows; other columns are not read.
    """
    ready(docs.sparkSession)
    base = aligner(byte_vocabulary, piece_model).base
    rows = stored(aligned(docs, byte_vocabulary, piece_model), "aligned")
    counts = stored(pair_counts(rows, base), "pairs")
    shards = max(1, -(-counts.count() // SHARD_PAIRS))
    folder, names = write_counts(counts, shards)
    drop_stored(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, LOOKUP_ROWS):
                part = batch.slice(lo, LOOKUP_ROWS)
                pairs, times = part.column("pairs"), part.column("times").flatten().to_numpy()
                n, best = look_up(pairs.flatten().to_numpy(), folder, names)
                row = np.repeat(np.arange(part.num_rows), pairs.value_lengths().to_numpy())
                sums = [np.zeros(part.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], row[best], times[best])
                np.add.at(sums[1], row, n * times)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), part.column("n_groups"),
                     *map(pa.array, sums), part.column("groups_sha256")], names=out,
                )

    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    # two groups never end together, and both sides' tokens have bytes: a group has one link
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in out)
    return rows.mapInArrow(run, schema)
