"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausal.llm.common import dropped, written


def settled(edges: DataFrame) -> bool:
    """Whether edges from a to a smaller b are stars: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of all nodes with an edge; label is the least node of the component. `edges` has columns a and b (long).

    Alternates large-star and small-star steps, which hang every node under the least
    one it knows, until all edges are stars; the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder, and only
    the last is kept. No group is ever gathered: a step aggregates a minimum and joins it.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        then = written(small, "edges")
        dropped(now)
        now = then
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = labels.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    labels._clausal_path = now._clausal_path  # so that dropped() deletes what they are read from
    return labels
