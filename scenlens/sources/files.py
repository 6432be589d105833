"""Delimited files with declared schemas.

Columns are found by the names in the header, in any order, case ignored; no inference pass is run.  Headers that are
repaired or doubled can be read by position instead.  What cannot be read fails the job: a line with too
few or too many fields, a value that is not of its type, a declared column that a file lacks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenlens.operators.reshape import to_long

MISSING_TEXTS = ("NA", "#N/A")


def _struct(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _marks(missing: str | Sequence[str]) -> list[str]:
    return [missing] if isinstance(missing, str) else list(missing)


def _typed(text: Column, field: T.StructField, marks: list[str]) -> Column:
    """The text as the declared type; an empty text or one of the marks is missing, any other misfit fails."""
    gap = text.isNull() | text.isin(["", *marks])
    value = F.trim(text).try_cast(field.dataType) if not isinstance(field.dataType, T.StringType) else text
    misfit = F.raise_error(F.concat(F.lit(f"column {field.name}: not a {field.dataType.simpleString()}: "), text))
    return F.when(gap, None).when(value.isNotNull(), value).otherwise(misfit.cast(field.dataType)).alias(field.name)


def _after_fronts(spark: SparkSession, path: str, skip: int, header: list[str] | None) -> DataFrame:
    """The lines, blank ones apart, that follow `skip` lines and a header in every file: value.

    One scan: a task meets a file's first block from its first line on and counts, so there is nothing to number,
    join or shuffle, and any number of blank lines may stand in front.  A file with another header than
    `header` fails the job; None takes any.  So does a file whose header lies beyond its first block.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        "value", F.xxhash64(meta.file_path).alias("file"), (meta.file_block_start == 0).alias("first"),
        (meta.file_block_length >= meta.file_size).alias("whole"),
    )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen, whole = None, skip + 1, True

        def leave() -> None:
            if seen <= skip and not whole:
                raise ValueError("a file's header lies beyond its first block: raise spark.sql.files.maxPartitionBytes")

        for batch in batches:
            values = batch.column("value")
            keep = np.asarray(pc.greater(pc.binary_length(values), 0)).astype(bool)
            files, first, wholes = (np.asarray(batch.column(c)) for c in ("file", "first", "whole"))
            change = (files[1:] != files[:-1]) | (first[1:] != first[:-1])
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(files)), bool), change)))
            for at, end in zip(starts, [*starts[1:], len(batch)], strict=True):
                if (files[at], first[at]) != file:
                    leave()
                    file, seen, whole = (files[at], first[at]), 0 if first[at] else skip + 1, wholes[at]
                front = at + np.flatnonzero(keep[at:end])[: skip + 1 - seen]
                keep[front] = False
                seen += len(front)
                if header is not None and len(front) and seen == skip + 1:
                    found = [c.strip() for c in next(csv.reader([values[front[-1]].as_py().lstrip("\ufeff")]))]
                    if found != header:
                        raise ValueError(f"header {found} in place of {header}")
            yield pa.RecordBatch.from_arrays([values.filter(pa.array(keep))], names=["value"])
        leave()

    return lines.mapInArrow(rest, "value string")


def _front_lines(spark: SparkSession, path: str, many: int, comment: str | None = None) -> list[str]:
    """The first lines, blank ones and comments apart, of the first file in the order of names that has any.

    They are read from the file's first bytes, by the driver and without a job; what other files begin with is checked in the scan.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at = hadoop.fs.Path(path)
    files = at.getFileSystem(conf)

    def named(entries) -> list:
        kept = [e for e in entries or [] if not e.getPath().getName().startswith(("_", "."))]
        return sorted(kept, key=lambda e: e.getPath().getName())

    def first_of(entries) -> list[str]:
        for entry in entries:
            inside = named(files.listStatus(entry.getPath())) if entry.isDirectory() else None
            found = first_of(inside) if inside is not None else lines_of(entry.getPath())
            if found:
                return found
        return []

    def lines_of(name) -> list[str]:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(name)
        stream = files.open(name)
        if codec is not None:
            stream = codec.createInputStream(stream)
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            found = []
            while len(found) < many and (line := reader.readLine()) is not None:
                if line and not (comment and line.startswith(comment)):
                    found.append(line)
            return found
        finally:
            reader.close()

    return first_of(named(files.globStatus(at)))


def _places(header: str, struct: T.StructType, path: str) -> list[str]:
    """Declared names in the order of the header; names of other columns are made up."""
    found = [c.strip().lower() for c in next(csv.reader([header.lstrip("﻿")]))]
    declared = {f.name.lower(): f.name for f in struct.fields}
    lacking = [f.name for f in struct.fields if f.name.lower() not in found]
    twice = sorted({c for c in found if c in declared and found.count(c) > 1})
    if lacking or twice:
        raise ValueError(f"{path}: header {found} lacks {lacking}, doubles {twice}")
    return [declared.get(c, f"__other_{i}") for i, c in enumerate(found)]


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, *,
    missing: str | Sequence[str] = MISSING_TEXTS, comment: str | None = None, positional: bool = False,
    every_field: bool = True,
) -> DataFrame:
    """CSV with a header line, the declared columns in the declared order.  No job runs before the scan.

    `missing` marks absent values.  All files of a folder must have the same header, which the scan checks file by
    file.  `positional` takes the header as it is and the columns by their place; then every line has exactly the declared fields.
    With `every_field` each line's fields are counted whatever is selected; without it the parser skips columns that
    are not selected, so lines of too few or too many fields are only met where all columns are read.
    """
    struct = _struct(schema)
    names = [f.name for f in struct.fields]
    header = None
    if not positional:
        front = _front_lines(spark, path, 1, comment)
        if not front:
            return spark.createDataFrame([], struct)
        names = _places(front[0], struct, path)
        header = [c.strip() for c in next(csv.reader([front[0].lstrip("﻿")]))]
    reader = (
        spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in (header or names)]))
        .option("header", True).option("enforceSchema", positional).option("mode", "FAILFAST")
        .option("columnPruning", not every_field)
    )
    if comment:
        reader = reader.option("comment", comment)
    raw = reader.csv(path).toDF(*names)
    return raw.select(*[_typed(F.col(f"`{f.name}`"), f, _marks(missing)) for f in struct.fields])


def read_csv_after(
    spark: SparkSession, path: str, schema: str | T.StructType, skip: int, *,
    missing: str | Sequence[str] = MISSING_TEXTS, positional: bool = False,
) -> DataFrame:
    """CSV whose header follows `skip` free-text lines; blank lines do not count.

    The front lines of every file are left out by their place, so a line of data may repeat their text, and the
    files are still read in splits, once.  The header's names come from the first file without a job; the scan
    checks the others'.  `positional` takes headers as they are.
    """
    struct = _struct(schema)
    front = _front_lines(spark, path, skip + 1)
    if len(front) <= skip:
        return spark.createDataFrame([], struct)
    names = [f.name for f in struct.fields] if positional else _places(front[skip], struct, path)
    header = None if positional else [c.strip() for c in next(csv.reader([front[skip].lstrip("\ufeff")]))]
    rows = _after_fronts(spark, path, skip, header)
    ddl = ", ".join(f"`{n}` string" for n in names) + ", `__broken` string"
    parsed = rows.select("value", F.from_csv("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("r"))
    misfit = F.raise_error(F.concat(F.lit("not a line of the file's columns: "), "value")).cast("string")
    text = lambda name: F.when(F.col("r.__broken").isNull(), F.col(f"r.`{name}`")).otherwise(misfit)
    return parsed.select(*[_typed(text(f.name), f, _marks(missing)) for f in struct.fields])


def read_sheets(
    spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, str | T.StructType]
) -> dict[str, DataFrame]:
    """One table per workbook sheet, each exported as CSV; sheets have doubled headers and are read by position."""
    return {sheet: read_csv(spark, path, schemas[sheet], positional=True) for sheet, path in paths.items()}


def read_wide_years(df: DataFrame, ids: list[str], value: str = "value") -> DataFrame:
    """Long form of a table with one column per year (`2050` or `X2050`); any other column is an error."""
    years = [c for c in df.columns if c not in ids]
    odd = [c for c in years if not c.removeprefix("X").isdigit()]
    if odd:
        raise ValueError(f"columns {odd} are neither ids nor years")
    long = to_long(df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in years]),
                   ids, years, "year", value)
    return long.withColumn("year", F.ltrim(F.col("year"), F.lit("X")).cast("int"))
