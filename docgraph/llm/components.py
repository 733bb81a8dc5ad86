"""Connected components of links by hooking to the smallest neighbour and shortening paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """For links (x, y): every ``node`` with the smallest node of its set as ``root``.

    Alternates large-star (larger neighbours go to the smallest one) and
    small-star (smaller neighbours go there too) on stored link tables until both
    leave the links as they are.  Every neighbourhood is an aggregate, never a list.
    """
    edges = stored(links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = stored(large.where("x <> y").distinct(), "links-large")
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.explode(F.array(F.struct(F.col("x"), F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.x", "e.y")
        new = stored(small.where("x <> y").distinct(), "links-small")
        changed = new.exceptAll(edges).limit(1).count() or edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            break
    pairs = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return pairs.union(edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
