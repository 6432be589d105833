"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table turns unit vectors by pseudo-rotations, three rounds of random signs and a fast Hadamard
transform, and hashes each to the nearest of the signed axes.  A query visits, in every table, the axes
nearest to it.  Equal vectors are one point of the index.  Buckets are numbers beside a vector, which is written
once and not once a table: a task holds a block of points and a slice of the queries, and distances are taken
where a query visits a point's bucket, on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenlens.llm.shared import ready, stored

#: Points and queries that one task compares.
BLOCK_POINTS = 1 << 13
BLOCK_QUERIES = 1 << 14
SEED = 20240229


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(dimension: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Random signs of three rounds for each table, over the next power of two."""
    size = 1 << max(0, dimension - 1).bit_length()
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, size))


def axis_scores(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """How near each turned unit vector is to each signed axis: first the positive, then the negative ones."""
    norms = np.linalg.norm(vectors / np.abs(vectors).max(axis=1, keepdims=True), axis=1, keepdims=True)
    x = np.zeros((len(vectors), signs.shape[1]))
    x[:, : vectors.shape[1]] = vectors / np.abs(vectors).max(axis=1, keepdims=True) / norms
    for row in signs:
        x = _hadamard(x * row)
    return np.concatenate([x, -x], axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def nearest_in(
    queries: np.ndarray, visits: np.ndarray, points: np.ndarray, homes: np.ndarray, buckets: int, most: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the numbers and distances of its nearest `most` points, and of all as near, among those it visits.

    A point lies in one bucket of every table (`homes`); a query visits several (`visits`: query, table, probe).
    """
    square = (points**2).sum(1)
    for lo in range(0, len(queries), 256):
        part = queries[lo : lo + 256]
        met = np.zeros((len(part), len(points)), bool)
        for t in range(homes.shape[1]):
            visited = np.zeros((len(part), buckets), bool)
            np.put_along_axis(visited, visits[lo : lo + 256, t], True, axis=1)
            met |= visited[:, homes[:, t]]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = square - 2.0 * (part @ points.T)
            slack = 1e-9 * (1.0 + (part**2).sum(1) + square.max(initial=0.0))
        for i, q in enumerate(part):
            near = np.flatnonzero(met[i])
            some = rough[i, near]
            if len(near) > most and np.isfinite(some).all():
                near = near[some <= np.partition(some, most - 1)[most - 1] + slack[i]]
            with np.errstate(over="ignore"):
                yield lo + i, near, np.sqrt(((points[near] - q) ** 2).sum(axis=1))


def _search(points: DataFrame, queries: DataFrame, dimension: int, tables: int, probes: int, most: int) -> DataFrame:
    """q, vec_id, score: the nearest found of every query vector (q, embedding) among points (ids, embedding).

    Points are dealt into blocks and queries into slices.  A vector's buckets travel beside it as numbers, so a
    point is moved once for every slice of queries, whatever the number of tables, and a pair is met in one place only.
    """
    signs = rotations(dimension, tables)
    buckets = 2 * signs.shape[2]
    probes = min(probes, buckets)

    def hashes(batches: Iterator[pd.DataFrame], visited: int) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.iloc[lo : lo + 2048]
                x = _matrix(part["embedding"])
                best = np.empty((len(part), tables, visited), "<i4")
                for t in range(tables):
                    scores = axis_scores(x, signs[t])
                    if visited == 1:
                        best[:, t, 0] = scores.argmax(1)
                    else:
                        best[:, t] = np.argsort(-scores, axis=1, kind="stable")[:, :visited]
                yield part.assign(at=[row.tobytes() for row in best])

    blocks, slices = -(-points.count() // BLOCK_POINTS), -(-queries.count() // BLOCK_QUERIES)
    dealt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.mapInPandas(lambda b: hashes(b, 1), _ddl(points, "at binary")).withColumn(
        "block", dealt("ids", max(1, blocks))
    ).withColumn("slice", every(max(1, slices)))
    right = queries.mapInPandas(lambda b: hashes(b, probes), _ddl(queries, "at binary")).withColumn(
        "slice", dealt("q", max(1, slices))
    ).withColumn("block", every(max(1, blocks)))

    def rerank(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(p) and len(v):
            names, ids = v["q"].to_numpy(), list(p["ids"])
            homes = np.frombuffer(b"".join(p["at"]), "<i4").reshape(len(p), tables)
            visits = np.frombuffer(b"".join(v["at"]), "<i4").reshape(len(v), tables, probes)
            for i, near, score in nearest_in(_matrix(v["embedding"]), visits, _matrix(p["embedding"]), homes, buckets, most):
                best = sorted((float(s), int(x)) for s, k in zip(score, near, strict=True) for x in ids[k])[:most]
                found += [(names[i], x, s) for s, x in best]
        return pd.DataFrame(found, columns=["q", "vec_id", "score"])

    by = ["block", "slice"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(rerank, "q long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([f"{name} {kind}" for name, kind in df.dtypes] + list(more))


def nearest(
    vectors: DataFrame, is_query, neighbours: int = 10, tables: int = 12, probes: int = 8,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows found for every row that `is_query` picks, its own id apart.

    Score is the Euclidean distance; ties go to the smaller id.  Rows whose vector is null, zero, or has a null or
    non-finite component, whose id is null, or whose length is not the most frequent one (of equally frequent, the
    longest) take no part.  Equal vectors are all found, through their smallest ids.  A query that meets fewer
    than `neighbours` rows is searched again through all buckets of a table, which is exact; an empty table gives no rows.
    """
    spark = ready(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"),
        is_query.alias("asks"),
    ).where(
        F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, most = sizes["n"], neighbours + 1
    rows = rows.where(F.size("embedding") == dimension)
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    points = stored(
        rows.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("embedding")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding"), "ann-points",
    )
    asking = rows.where("asks").select("vec_id", "embedding")
    asked = stored(asking.groupBy("embedding").agg(F.min("vec_id").alias("q")).select("q", "embedding"), "ann-queries")
    found = stored(_search(points, asked, dimension, tables, probes, most), "ann-found")
    short = asked.join(found.groupBy("q").agg(F.count("*").alias("n")), "q", "left").where(
        F.coalesce("n", F.lit(0)) < most
    ).select("q", "embedding")
    short = stored(short, "ann-short")
    if not short.isEmpty():
        again = _search(points, short, dimension, 1, 2 << max(0, dimension - 1).bit_length(), most)
        found = found.join(short.select("q"), "q", "left_anti").unionByName(again)
    names = asking.join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "q")
    pairs = names.join(found, "q").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
