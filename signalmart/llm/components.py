"""Connected components of an edge table, by alternating large-star and small-star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmart.sources.shared import remove, shared_folder


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's larger neighbours (or the node and its smaller ones) on the smallest neighbour."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    hung = around.join(lowest, "a")
    if large:
        moved = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``a, b`` edges; a component's name is its smallest node.

    Each round is written to the shared folder, so the plan stays short; rounds grow with
    the logarithm of the longest chain.  Nulls and loops are left out.
    """
    spark = edges.sparkSession
    current = edges.where("a != b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct()
    seen, path = None, None
    while True:
        following = shared_folder(spark, "components")
        _stars(_stars(current, True), False).write.parquet(following)
        before, path = path, following
        current = spark.read.schema("a long, b long").parquet(path)
        mark = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if before:
            remove(spark, before)
        if mark == seen:
            break
        seen = mark
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
