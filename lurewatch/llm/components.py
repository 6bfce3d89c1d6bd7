"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shuffles_removed


def _state(edges: DataFrame) -> tuple[int, int]:
    with shuffles_removed(edges.sparkSession):
        r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r.n, r.x or 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round is a grouped minimum, combined before its shuffle, and a join of the edges with it. A node with very
    many neighbours is a skewed key of that join, of edges of two nodes each, which adaptive execution splits; its
    edges are never gathered in one row. Rounds are logarithmic in the longest path. Edges are rewritten until nothing
    changes; each round is written to the shared folder and the one before deleted. Edges with a null end and loops are ignored; an empty table gives an empty result.
    """
    now = materialize(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, now = now, materialize(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        discard(old)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.written_at = now.written_at
    return out
