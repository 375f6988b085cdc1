"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _star(tables: Tables, edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Each step ties the neighbours of a node to the least of them.

    The least are written before they meet the edges: as a side of its own the join can split a node with very many edges.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = tables.cut(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
    met = around.join(least, "u")
    if large:
        tied = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = tables.cut(tied.where("u <> v").distinct())
    tables.free(least)
    return out


def components(tables: Tables, links: DataFrame, a: str, b: str) -> DataFrame:
    """u, comp for every node that has a link; comp is the least node that links reach."""
    edges = tables.cut(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        before, half = edges, _star(tables, edges, True)
        edges = _star(tables, half, False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tables.free(before, half)
        if now == state:
            break
        state = now
    top = edges.select(F.col("v").alias("u"), F.col("v").alias("comp")).distinct()
    return edges.select("u", F.col("v").alias("comp")).unionByName(top)
