"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of the undirected edges, the component being its
    smallest node. Edges with a null end are ignored; nodes without edges are absent.

    Alternates two steps until nothing changes: every node sends its larger neighbours to
    the smallest node it knows, then its smaller ones. Minima are pre-aggregated per task,
    and each round is written to the shared folder, which cuts the lineage.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = cut(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    state = _state(links)
    while True:
        links = cut(_small_star(_large_star(links)), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    near = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
