"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm._store import forget, keep


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, root for each end of `edges` (columns a, b: longs); root is the least id of its component.

    Edges with a null end are left out; repeated ones count once.  No group is gathered in
    a row: each end's least neighbour is an aggregate, joined back to the edges, and that
    join is split where one end has very many.  Each round writes the edges to the shared folder, so lineage doesn't grow; rounds grow
    with the logarithm of the longest path.
    """
    now = keep(edges.dropna(subset=["a", "b"]).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges")
    before = None
    for _ in range(most):
        # Large star: every neighbour above u moves to u's least neighbour (or u).
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        # Small star: every neighbour below u, and u, move to the least of them.
        large = keep(large, "edges")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        last, now = now, keep(small, "edges")
        forget(last, large)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
