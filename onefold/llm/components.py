"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.session import settle


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in a link, root the smallest id that can be reached.

    ``links`` has two long columns a and b. Each round hangs larger neighbours on the smallest
    one (large star), then smaller ones likewise (small star); rounds grow with the logarithm of
    the longest chain. Minima are partial aggregates, so a node with very many links is no
    bottleneck. Every round is written to the shared checkpoint folder.
    """
    links = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(links)
        if mark == before:
            break
    roots = links.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
