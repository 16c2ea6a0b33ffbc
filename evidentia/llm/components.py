"""Connected components of a graph given as a table of edges.

Every round, each vertex hooks to its smallest neighbour if that is smaller, the hooks are
followed to their roots by pointer doubling, and the edges are rewritten to roots.  A round at
least halves the vertices that still have edges, so there are few rounds, each a handful of
joins over tables that shrink.  Nothing but row counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _to_root(parents: DataFrame, rows: int) -> DataFrame:
    """(v, p) with p the root of v, by pointer doubling.  Roots have no row; there are at most that many."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = parents.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
        jumped = materialise(jumped, "hooks", rows)
        done = jumped.filter("moved").isEmpty()
        parents = jumped.select("v", "p")
        if done:
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): every vertex with an edge to another vertex, and the smallest vertex of its component."""
    left = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    first = n = left.count()
    while n:
        parents = _to_root(left.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), n)
        if found is None:
            found = parents
        else:
            # vertices of earlier rounds follow their root; roots that hooked now join them
            up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            found = found.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")).unionByName(parents)
            found = materialise(found, "found", first)
        pa, pb = parents.select(F.col("v").alias("a"), F.col("p").alias("ra")), parents.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        moved = left.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b")
        left = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", n)
        n = left.count()
    if found is None:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = found.select(F.col("p").alias("v"), F.col("p").alias("root")).distinct()
    return found.select("v", F.col("p").alias("root")).unionByName(roots)
