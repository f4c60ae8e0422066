"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import cut

#: Edges that one task may handle; fewer are kept in one partition, so small graphs need no shuffles.
TASK_EDGES = 200_000


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for every node of an edge list ``(a, b)``: the smallest node it is joined to.

    Minima are aggregated before they are shuffled, so hubs cost one row per task; each round is cut into
    the shared folder.  Null ends and loops are ignored; an empty edge list gives an empty result.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now = cut(now)
    mark = _fingerprint(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        small = mark[0] <= TASK_EDGES
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if small else both
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        moved = moved.union(least.select("a", F.col("m").alias("b")))
        now = cut((moved.coalesce(1) if small else moved).distinct())
        then, mark = mark, _fingerprint(now)
        if then == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
