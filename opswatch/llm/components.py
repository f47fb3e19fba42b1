"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """(node, near) with the smallest of node's neighbours and itself; ``node`` is the grouping side.

    Both sides are shuffled by then: a merge join sends nothing small through the driver, round for round.
    """
    least = pairs.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("least")).withColumnRenamed("node", "own")
    return pairs.join(least.hint("merge"), F.col("node") == F.col("own")).drop("own")


def _written(pairs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """Distinct links (a, b) of two nodes each, stored, with their number and a checksum."""
    return counted(pairs.filter("a <> b").distinct(), checksum=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b bigint); the root is the smallest node it can reach.

    Large and small star steps alternate until nothing changes. Each step is one aggregation and one join
    on the node, both of which combine or split a hub's rows; every round is one query, written to the shared
    folder, so lineage stays short and a lost executor costs one round at most. Nothing is gathered on the driver
    but a count and a checksum, taken as the round is written.
    """
    edges, seen = _written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(rounds if seen["n"] else 0):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        large = _with_smallest(both).filter("near > node").select(F.col("near").alias("node"), F.col("least").alias("near"))
        # no more rows than links: repeated ones need not be brought together twice
        small = _with_smallest(large.filter("near <> node")).select(
            F.explode(F.array(F.struct(F.col("near").alias("a")), F.struct(F.col("node").alias("a")))).alias("x"), "least"
        )
        edges, now = _written(small.select(F.col("x.a").alias("a"), F.col("least").alias("b")))
        if now == seen:
            break
        seen = now
    else:
        if seen["n"]:
            raise RuntimeError("components did not settle; raise rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
