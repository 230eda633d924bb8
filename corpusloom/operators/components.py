"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.tables import stage, unstage


#: The minima of up to so many edges (a few MB) are broadcast; those of more are shuffled.
BROADCAST_EDGES = 100_000


def _minimum(pairs: DataFrame, few: bool) -> DataFrame:
    """Adds to each (u, v) the least of u and its neighbours as ``m``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(F.broadcast(least) if few else least, F.col("u") == F.col("k")).drop("k")


def connected_components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Labels every vertex that has an edge with the smallest vertex it can reach.

    Returns ``vertex, component``. In a large-star round each vertex sends its
    larger neighbours to its least one, in a small-star round the others; rounds
    go on until the edges no longer change. Only per-vertex minima are
    aggregated (combined before the shuffle); no neighbour list is gathered.

    Edges with a null end and self-edges say nothing and are left out; repeated
    edges count once; without edges the result is empty.
    """
    now = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null and a <> b")
    now = stage(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, few = state, state[0] <= BROADCAST_EDGES
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _minimum(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = _minimum(large, few)
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select("u", "m")).filter("a <> b").distinct()
        old, now = now, stage(small.coalesce(1 + state[0] // BROADCAST_EDGES), "components")
        unstage(old)
    roots = now.select(F.col("b").alias("vertex")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots.select("vertex", F.col("vertex")))
