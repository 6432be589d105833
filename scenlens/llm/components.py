"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenlens.llm.shared import drop_stored, stored


#: Parts of a node's edges; a hub's are spread over as many tasks.
SALTS = 64


def _with_least(pairs: DataFrame) -> DataFrame:
    """u, v and m, the smallest v of each u.

    The smallest is found per part of a node's edges first and joined back to those parts that occur, so no task holds all edges of a hub.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = (
        salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
        .groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
        .select("u", "m", F.explode("salts").alias("salt"))
    )
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label: every node of the edges (a, b, both long) and the smallest node it can reach.

    Loops, repeated and null ends are passed over; nodes without another end are not returned.
    Every round is written to the shared folder; the driver sees a count and a checksum of the edges.
    """
    now = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = _print(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # every end of a large star once more: its own smallest becomes the centre
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = _with_least(large).select(ends.alias("e")).select("e.u", "e.v").where("u != v").distinct()
        then = stored(small, "edges")
        drop_stored(now)
        now, before = then, seen
        seen = _print(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
