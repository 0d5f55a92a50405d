"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Each round joins every node to the smallest neighbour of its neighbours (a large star, then a small star), which
    shortens paths by a constant factor; each round is written out. A hub's neighbours are spread over tasks, as every
    step is a join or an aggregate with partial sums.
    """
    edges = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low <> high").distinct()
    edges = stored(edges, "links")
    while True:
        both = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(edges.select(F.col("high").alias("node"), F.col("low").alias("other")))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))
        large = both.where("other > node").join(least, "node").select(F.col("root").alias("low"), F.col("other").alias("high")).where("low <> high").distinct()
        small = large.groupBy("high").agg(F.min("low").alias("root"))
        moved = large.join(small, "high").select(F.col("root").alias("x"), "low", "high")
        pairs = moved.select("x", F.explode(F.array("low", "high")).alias("y")).where("x <> y").distinct()
        new = stored(pairs.select(F.col("x").alias("low"), F.col("y").alias("high")), "links")
        if new.count() == edges.count() and new.join(edges, ["low", "high"], "left_anti").isEmpty():
            return new.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(new.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        edges = new
