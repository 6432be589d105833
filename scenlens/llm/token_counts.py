"""Documents and their token counts in flat token files that have no index.

A file is read in blocks, each by any task.  A block's separators are found by one
vectorised comparison; a prefix scan over the blocks of a file tells each block how many
documents ended before it and where the open one began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenlens.llm.shared import ready
from scenlens.llm.token_files import NO_ID, read_array

BLOCK_TOKENS = 8 << 20

_SCAN = "folder string, name string, width long, block long, at long, length long, n_ends long, last_end long"
_DOCS = "doc_id long, folder string, name string, ordinal long, start long, n_tokens long, terminated boolean"


def _ends(row: dict, separator: int) -> np.ndarray:
    """Positions in the file of the separators of a block."""
    ids = read_array(row["folder"], row["name"] + ".ids", f"<u{row['width']}", row["at"], row["length"])
    return row["at"] + np.flatnonzero(ids == separator)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def token_counts(files: DataFrame, separator: int, block_tokens: int = BLOCK_TOKENS, named: bool = False) -> DataFrame:
    """One row a document of the files (folder, name, width, n_tokens): ordinal in its file, start, n_tokens.

    Counts include the separator.  What follows the last separator of a file is a document with
    `terminated` false; two separators in a row end an empty document of one token.  Files without
    ids give no rows.  `named` takes `doc_id` by ordinal from the `.doc` file beside the ids; else it is null.
    """
    ready(files.sparkSession)
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (
        files.where(F.col("n_tokens") > 0)
        .withColumn("block", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {block_tokens}L)")))
        .select(
            "folder", "name", F.col("width").cast("long").alias("width"), "block",
            (F.col("block") * block_tokens).alias("at"),
            F.least(F.lit(block_tokens), F.col("n_tokens") - F.col("block") * block_tokens).cast("long").alias("length"),
            (F.col("n_tokens") <= (F.col("block") + 1) * block_tokens).alias("last_block"),
        )
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ends = _ends(row, separator)
            row |= {"n_ends": len(ends), "last_end": int(ends[-1]) if len(ends) else None}
            yield pa.RecordBatch.from_pylist([row], schema=_schema(_SCAN + ", last_block boolean"))

    scanned = blocks.repartition(tasks, "name", "block").mapInArrow(scan, _SCAN + ", last_block boolean")
    before = Window.partitionBy("folder", "name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.select(
        "*",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal"),
        (F.coalesce(F.max("last_end").over(before), F.lit(-1)) + 1).alias("open_at"),
    ).where((F.col("n_ends") > 0) | F.col("last_block"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ends = _ends(row, separator)
            stop, done = row["at"] + row["length"], np.ones(len(ends), bool)
            if row["last_block"] and stop > (ends[-1] + 1 if len(ends) else row["open_at"]):
                ends, done = np.append(ends, stop - 1), np.append(done, False)
            starts = np.concatenate(([row["open_at"]], ends[:-1] + 1)) if len(ends) else ends
            n = len(ends)
            ids = np.full(n, NO_ID)
            if named:
                ids = np.asarray(read_array(row["folder"], row["name"] + ".doc", "<i8", row["ordinal"], n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array([row["folder"]] * n, pa.string()),
                    pa.array([row["name"]] * n, pa.string()), pa.array(np.arange(n) + row["ordinal"], pa.int64()),
                    pa.array(starts, pa.int64()), pa.array(ends + 1 - starts, pa.int64()), pa.array(done, pa.bool_()),
                ],
                schema=_schema(_DOCS),
            )

    return stitched.repartition(tasks, "name", "block").mapInArrow(count, _DOCS)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])
