"""Connected components of a link table, as Spark joins.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each round points nodes at smaller
neighbours, and the table ends as one star per component.  Rounds grow with
the logarithm of the longest chain; each is cut by a reliable checkpoint.
Nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plume.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, root): the smallest node reachable, for
    every node that has a link.  Self links and nulls are ignored."""
    pairs = (links.filter(F.col("a") != F.col("b"))
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    pairs = C.checkpoint(pairs)
    before = _mark(pairs)
    while before[0]:
        pairs = C.checkpoint(_small_star(_large_star(pairs)))
        now = _mark(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(pairs: DataFrame) -> tuple[int, str]:
    row = pairs.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, str(row.s)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node points its larger neighbours at its smallest neighbour."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.filter(F.col("v") > F.col("u"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node points its smaller neighbours, and itself, at the smallest."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = (pairs.join(least, "u").filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
