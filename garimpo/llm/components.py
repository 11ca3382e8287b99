"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest of the vertex and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", "m")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a vertex without other edges to its centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("out").alias("n"), F.max("centre").alias("c")).where("n > 1 or (n > 0 and c > 0)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """u, v for each vertex u of ``links(u, v)`` that isn't the smallest of its component, v being that smallest.

    Every step is an aggregate and a join on the vertex; only whether all are stars by now comes to the driver.
    Self-links, repeated links and an empty table are allowed; links with a NULL end are ignored.
    """
    # edges are 16 bytes: two partitions a core hold them, however many the shuffles have
    parts = 2 * links.sparkSession.sparkContext.defaultParallelism
    edges = checkpoint(links.where("u != v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct().coalesce(parts))
    while not _stars(edges):
        edges = checkpoint(_small_star(_large_star(edges)).coalesce(parts))
    return edges
