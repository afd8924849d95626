"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, comp) for every end of an edge ``(a, b)``; comp is the smallest id it can reach.

    Every round is two grouped minima with map-side combining and two joins on the same key
    (a hot centre is split by AQE's skew join); it needs O(log^2 n) rounds. Edges with a null
    end and loops are ignored. Nothing but a count and a checksum reaches the driver.
    """
    cur = store(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _state(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, cur = cur, store(small, "cc")
        now = _state(cur)
        drop_stored(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    low = cur.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("id"), "comp")
    return low.unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
