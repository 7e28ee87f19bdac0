"""Connected components of a link table by alternating large and small stars; logarithmic rounds, all in joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfield.llm.runtime import Scratch


def stars(links: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """links (a, b) of ids (about ``rows``) -> (node, root): every node that isn't the smallest of its component, and that smallest.

    Null or equal ends are no links.  No links: empty.  Minima are taken map-side first, so a node with many links is
    no hot group; the joins back are plain equi-joins, whose skewed partitions AQE splits.
    """
    now = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "links", rows=rows)
    while True:
        child = now.select(F.col("node").alias("other"))
        n, nodes = now.agg(F.count("*"), F.count_distinct("node")).first()
        if n == nodes and now.join(child, now["root"] == child["other"], "left_semi").isEmpty():
            return now
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(now.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).where("node <> root")
        after = scratch.save(small.unionByName(least.select(F.col("u").alias("node"), F.col("m").alias("root"))).distinct(), "stars", rows=2 * n)
        scratch.drop(now)
        now = after
