"""Flat token files: unsigned integers one after another, and 64-bit offsets of the documents.

A set of files is a folder of parts and a manifest.  Part k holds the documents of
one range of ids, ascending:

* `<name>.ids`  the ids of its documents, little-endian unsigned 16- or 32-bit;
* `<name>.off`  one more than its documents, little-endian unsigned 64-bit: where each begins, and the end;
* `<name>.doc`  its document ids, little-endian signed 64-bit; a null id is the smallest value.

The manifest has a row per part; `base`, the ids before the part, is the prefix sum of
the parts' counts.  A task writes under names of its own and reports them when it is
done, so a repeated or lost task leaves files that no manifest names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenlens.llm.shared import new_folder, ready, stored
from scenlens.llm.tokens import ID, encoder

NO_ID = np.iinfo("<i8").min
PART_BYTES = 128 << 20


def file_system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and path of a folder that Spark names."""
    if folder.startswith("file:") or "://" not in folder:
        return arrow_fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(folder)


def read_array(folder: str, name: str, dtype, start: int = 0, count: int | None = None) -> np.ndarray:
    """`count` values of a file from `start`, memory-mapped where the file system is local."""
    fs, path = file_system(folder)
    width, path = np.dtype(dtype).itemsize, f"{path}/{name}"
    if isinstance(fs, arrow_fs.LocalFileSystem):
        size = fs.get_file_info(path).size // width - start
        count = size if count is None else min(count, size)
        return np.memmap(path, dtype, "r", start * width, (count,)) if count > 0 else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        count = f.size() // width - start if count is None else count
        f.seek(start * width)
        return np.frombuffer(f.read(max(0, count) * width), dtype)


def write_token_files(
    docs: DataFrame, vocabulary: str, end_id: int, plain_text: bool = False, width: int = 2,
    folder: str | None = None, part_bytes: int = PART_BYTES, by_id: bool = True,
) -> DataFrame:
    """Encodes `text` of every row, writes the files in ascending `doc_id`, returns the manifest.

    Without `by_id` a part holds what a task reads, in the order of the table, and no text is moved.

    Null text counts as empty: the end id alone.  Rows of one id stay together in the order of their
    texts' hashes; rows without an id come first.  Other columns are not read.  An empty table
    gives no parts.  Manifest: part, folder, name, width, n_docs, n_tokens, base, first_doc.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    if by_id:
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
        rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    to, most = folder or new_folder(spark, "token-files"), 1 << 8 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(to)
        enc, end = encoder(vocabulary, plain_text), np.array([end_id], ID)
        name, out, offsets, ids = f"part-{uuid.uuid4().hex}", None, [np.zeros(1, "<u8")], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}.ids")
            sizes = []
            for found in enc.encode_many(text.as_py() for text in batch.column("text")):
                values = np.concatenate([found, end])
                if values.max() >= most:
                    raise ValueError(f"an id does not fit {width} bytes")
                out.write(values.astype(f"<u{width}").tobytes())
                sizes.append(len(values))
            offsets.append(offsets[-1][-1] + np.cumsum(sizes, dtype="<u8"))
            ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8"))
        if out is None:
            return
        out.close()
        for kind, data in (("off", offsets), ("doc", ids)):
            with fs.open_output_stream(f"{path}/{name}.{kind}") as f:
                for piece in data:
                    f.write(piece.tobytes())
        row = {
            "part": [TaskContext.get().partitionId()], "folder": [to], "name": [name], "width": [width],
            "n_docs": [sum(map(len, ids))], "n_tokens": [int(offsets[-1][-1])],
        }
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([
            ("part", pa.int64()), ("folder", pa.string()), ("name", pa.string()), ("width", pa.int64()),
            ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
        ]))

    schema = "part long, folder string, name string, width long, n_docs long, n_tokens long"
    written = stored(rows.mapInArrow(run, schema), "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.select(
        "*",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("first_doc"),
    )


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row a document, from the files alone: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    `start` counts the ids of all documents before it; the checksum is over 32-bit ids.
    """
    block = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                ids = read_array(part["folder"], part["name"] + ".ids", f"<u{part['width']}")
                offsets = read_array(part["folder"], part["name"] + ".off", "<u8").astype(np.int64)
                names = read_array(part["folder"], part["name"] + ".doc", "<i8")
                for lo in range(0, len(names), block):
                    cut = offsets[lo : lo + block + 1]
                    docs = [np.asarray(ids[a:b]).astype(ID) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    some = np.asarray(names[lo : lo + block])
                    out = [
                        pa.array(some, pa.int64(), mask=some == NO_ID), pa.array(cut[:-1] + part["base"], pa.int64()),
                        pa.array(np.diff(cut), pa.int64()), pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                    ]
                    if with_ids:
                        out.append(pa.array([d.tolist() for d in docs], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, names=names_out)

    names_out = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    spark: SparkSession = ready(manifest.sparkSession)
    spread = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return spread.mapInArrow(run, schema)
