"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, split_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b long) as stars: each node but a component's least, once as ``a``, with that least as ``b``.

    Self-loops and repeated edges don't matter; no edges give no rows. Every round is written to
    the shared checkpoint folder; rounds grow with the logarithm of the longest chain.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # a star's centre may have a third of all edges
        large = split_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(down, least, ["a"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = durable(small)
        before, state = state, _state(now)
        if state == before:
            return now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
