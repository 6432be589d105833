"""Removes lines that many documents share, by a sharded minimal perfect hash over line hashes.

Lines are counted by their 64-bit hash; no line text is shuffled.  The hashes found in two documents or
more are split into shards, and each shard becomes a minimal perfect hash with a 32-bit fingerprint and
a count per slot, a file in the shared folder.  Tasks map the shards that their documents' lines fall in
into memory and look the hashes up there, whatever the size of the index; nothing of it passes the driver.

Two different lines may share a 64-bit hash (for n distinct lines, expect n * n / 2^65 such pairs), and a
line of a single document, which has no slot, may meet another's fingerprint (one in 2^32).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenlens.llm.shared import free_name, new_folder, ready, stored
from scenlens.llm.token_files import file_system, read_array

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of a shard, which takes about 13 bytes each.
SHARD_KEYS = 1 << 20
_WORD = np.uint64(64)


def lines_of(text: Column) -> Column:
    """The lines of a text; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """Hash of a line's key, null for an empty key."""
    key = F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)
    return F.when(key != "", F.xxhash64(key))


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of the keys, another for each seed."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


@dataclass
class Shard:
    """Bit arrays, one level after another: a key's level is the first where it has a bit to itself."""

    sizes: np.ndarray  # bits of each level, multiples of 64
    words: np.ndarray
    ranks: np.ndarray  # set bits before each word
    fingerprints: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Shard:
        """Distinct unsigned 64-bit keys and their counts, which saturate at 2^32 - 1; the order of keys does not matter."""
        rest, sizes, bits = keys, [], []
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = (_mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        packed = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little").view("<u8")
        ones = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
        shard = cls(
            np.array(sizes, "<i8"), packed, np.concatenate(([0], ones[:-1])).astype("<u4") if len(ones) else ones.astype("<u4"),
            np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4"),
        )
        slots = shard.slots(keys)
        shard.fingerprints[slots] = _fingerprint(keys)
        shard.counts[slots] = np.minimum(counts, 2**32 - 1)
        return shard

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for one that has no bit on any level."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[hit]] = (self.ranks[at >> 6].astype(np.int64) + np.bitwise_count(below))[hit]
            todo, base = todo[~hit], base + int(size)
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the keys, 0 for those that are not in the shard."""
        slots = self.slots(keys)
        found = slots >= 0
        found[found] = self.fingerprints[slots[found]] == _fingerprint(keys[found])
        out = np.zeros(len(keys), np.int64)
        out[found] = self.counts[slots[found]]
        return out

    def tobytes(self) -> bytes:
        """The lengths of the arrays as 64-bit integers, then the arrays."""
        arrays = [getattr(self, k) for k in _KINDS]
        return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def of(cls, data: np.ndarray) -> Shard:
        """The shard in the bytes of a file, of which nothing is copied."""
        lengths, at, arrays = data[: 8 * len(_KINDS)].view("<i8"), 8 * len(_KINDS), {}
        for (name, kind), n in zip(_KINDS.items(), lengths, strict=True):
            end = at + int(n) * np.dtype(kind).itemsize
            arrays[name], at = data[at:end].view(kind), end
        return cls(**arrays)


#: Wider kinds first, so that each array begins at a multiple of its width.
_KINDS = {"sizes": "<i8", "words": "<u8", "ranks": "<u4", "fingerprints": "<u4", "counts": "<u4"}


def _write_shard(folder: str, number: int, shard: Shard) -> None:
    """A task's file gets its name when it is whole; a repeated task would write the same bytes and leaves it."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    own, name = f"{path}/_{uuid.uuid4().hex}", f"{path}/shard-{number}"
    with fs.open_output_stream(own) as f:
        f.write(shard.tobytes())
    try:
        fs.move(own, name)
    except OSError:
        if fs.get_file_info(name).type != arrow_fs.FileType.File:
            raise


@lru_cache(maxsize=16)
def open_shard(folder: str, number: int) -> Shard | None:
    """A shard, mapped into memory where the file system is local; None for one without keys, which has no file."""
    fs, path = file_system(folder)
    if fs.get_file_info(f"{path}/shard-{number}").type != arrow_fs.FileType.File:
        return None
    return Shard.of(np.asarray(read_array(folder, f"shard-{number}", "u1")))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((_mix(keys, 1 << 21) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def line_index(docs: DataFrame, text: str = "text", shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """A folder with a file per shard over the line hashes of two documents or more, and the number of shards."""
    spark = ready(docs.sparkSession)
    hashes = F.transform(lines_of(F.col(text)), line_hash)
    counted = (
        docs.select(F.explode(F.array_distinct(hashes)).alias("h")).where("h IS NOT NULL")
        .groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    )
    counted = stored(counted, "line-counts")
    shards, folder = max(1, -(-counted.count() // shard_keys)), new_folder(spark, "line-shards")

    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series(shard_of(h.to_numpy(np.int64).view(np.uint64), shards))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _write_shard(folder, key[0], Shard.build(rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy()))
        return pd.DataFrame({"keys": [len(rows)]})

    numbered = counted.withColumn("shard", F.pandas_udf(number, "long")("h"))
    numbered.groupBy("shard").applyInPandas(build, "keys long").agg(F.sum("keys")).first()
    return folder, shards


def often_in(folder: str, shards: int, min_docs: int) -> Callable[[Column], Column]:
    """Column function: for each hash of an array, whether `min_docs` documents or more have it."""

    @F.arrow_udf("array<boolean>")
    def often(column: pa.Array) -> pa.Array:
        keys = column.flatten()
        known = np.flatnonzero(np.asarray(keys.is_valid()))
        values = keys.fill_null(0).to_numpy().view(np.uint64)
        homes = shard_of(values[known], shards)
        order = np.argsort(homes, kind="stable")
        cuts = np.flatnonzero(np.diff(homes[order])) + 1
        flags = np.zeros(len(values), bool)
        for some in np.split(order, cuts) if len(order) else []:
            shard = open_shard(folder, int(homes[some[0]]))
            if shard is not None:
                flags[known[some]] = shard.look_up(values[known[some]]) >= min_docs
        ends = np.cumsum(np.concatenate(([0], column.value_lengths().to_numpy())))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flags))

    return often


def drop_common_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Every row with its text less the lines whose key is in `min_docs` documents or more; adds n_lines, n_dropped.

    A key is a line without white space at its ends, A-Z in lower case; empty keys stay.  `min_docs` is 2 or
    more.  A document counts once however often it repeats a line; rows of one id are documents of their own.
    Null text becomes empty; a text that loses all lines becomes empty.  The columns n_lines and n_dropped are
    replaced where they are there; others stay, whatever their names.  An empty table gives no rows.
    """
    if not 2 <= min_docs < 2**32:
        raise ValueError("min_docs must be from 2 to 2^32 - 1")
    folder, shards = line_index(docs, text, shard_keys)
    rows = docs.drop("n_lines", "n_dropped")
    flag = free_name(rows, "often")
    flagged = rows.withColumn(flag, often_in(folder, shards, min_docs)(F.transform(lines_of(F.col(text)), line_hash)))
    kept = F.filter(lines_of(F.col(text)), lambda _, i: ~F.get(F.col(flag), i))
    dropped = F.size(F.filter(flag, lambda x: x))
    return flagged.select(
        *[F.array_join(kept, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns],
        F.size(flag).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"),
    )
