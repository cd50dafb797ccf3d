"""Connected components by alternating large-star and small-star joins.

The number of rounds grows with the logarithm of the size, and every round is two joins on the
edge table, written out to cut lineage (Kiveris et al., 2014).
"""

from pyspark.sql import DataFrame, functions as F

from .durable import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of its neighbours and itself."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pos, root: root is the least position of the component."""
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    while True:
        edges = written(_small_star(written(_large_star(edges))))
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "pos")
    return nodes.join(roots, "pos", "left").select("pos", F.coalesce("root", "pos").alias("root"))
