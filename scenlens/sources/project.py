"""A project is a bundle of named long tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORE_COLUMNS = ("scenario", "region", "year", "value", "Units")
_INDEX = "_index"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's `spark.checkpoint.dir`, or what `setCheckpointDir` was given."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def _slug(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name.lower())


def tidy_header(name: str) -> str:
    """Column name as the plans expect it.

    A repaired double header `x...3` becomes `x_3`, and a model's own consumer
    column (`<model>-consumer`) becomes `consumer`.
    """
    if name.endswith("-consumer"):
        return "consumer"
    return name.replace("...", "_")


def _has_index(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{_INDEX}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _index(spark: SparkSession, root: str) -> DataFrame:
    """The entries of all saves: query, folder, version."""
    return spark.read.schema("query string, folder string, version long").option("recursiveFileLookup", True).json(
        f"{root}/{_INDEX}"
    )


class Project:
    """Named tables, fetched by name; missing names and columns are errors."""

    def __init__(self, tables: Mapping[str, Callable[[], DataFrame]]):
        self._tables = dict(tables)
        self._opened: dict[str, DataFrame] = {}

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, names: Mapping[str, str]) -> Project:
        """Tables of a catalog database; `names` maps query name to table name."""
        present = {t.name.lower() for t in spark.catalog.listTables(database)}
        return cls({
            query: (lambda t=table: spark.table(f"{database}.{t}"))
            for query, table in names.items() if table.lower() in present
        })

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> Project:
        """Tables written by `save`; of several under one name, that of the highest version, then of the last folder name."""
        latest = _index(spark, root).groupBy("query").agg(F.max_by("folder", F.struct("version", "folder")).alias("folder"))
        return cls({
            r.query: (lambda f=r.folder: spark.read.parquet(f"{root}/{f}")) for r in latest.collect()
        })

    @staticmethod
    def save(df: DataFrame, root: str, name: str, partition_by: tuple[str, ...] = ("scenario",)) -> None:
        """Write one named table, partitioned so that scenario filters prune files.

        The table is listed under the version after the highest one that was listed when its files were whole.  Each
        entry is a folder of its own, so saves at one time do not touch each other's files: both are listed, and of
        two with one version the folder name decides, for every reader alike.
        """
        folder = f"{_slug(name)}_{uuid.uuid4().hex[:8]}"
        df.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(f"{root}/{folder}")
        spark = df.sparkSession
        listed = _index(spark, root).agg(F.max("version")).first()[0] if _has_index(spark, root) else None
        entry = spark.range(1).select(
            F.lit(name).alias("query"), F.lit(folder).alias("folder"), F.lit((listed or 0) + 1).cast("long").alias("version")
        )
        entry.write.json(f"{root}/{_INDEX}/{folder}")

    def names(self) -> list[str]:
        return sorted(self._tables)

    def query(self, name: str, *extra: str) -> DataFrame:
        """The named table; `extra` lists columns it must have besides year and value."""
        if name not in self._tables:
            raise KeyError(f"no query {name!r}; have {self.names()}")
        if name not in self._opened:
            raw = self._tables[name]()
            self._opened[name] = raw.withColumnsRenamed({c: tidy_header(c) for c in raw.columns if tidy_header(c) != c})
        df = self._opened[name]
        lacking = [c for c in ("scenario", *extra) if c not in df.columns]
        if lacking:
            raise ValueError(f"query {name!r} lacks columns {lacking}")
        return df

    def scenarios(self) -> DataFrame:
        """Distinct scenario labels over all tables."""
        labels = None
        for name in self.names():
            part = self.query(name).select("scenario").distinct()
            labels = part if labels is None else labels.union(part)
        return labels.distinct()
