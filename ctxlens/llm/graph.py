"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.runtime import stage


def components(edges: DataFrame) -> DataFrame:
    """Node and the smallest node it can reach, for every node of an edge.

    `edges` has long columns a and b. Alternates two star steps: a node hands the
    least of its neighbours to its larger neighbours, then to its smaller ones.
    Edges never grow in number and become stars in about log^2 n rounds. Each step
    is a minimum with a partial aggregation and a join that AQE may split, so a
    hub is never one task's group. Each round's edges are written to the shared
    checkpoint folder. An edge table without rows gives none.
    """
    now = stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        # Written, so that Spark can split the join where a hub has many edges.
        least = stage(
            both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least"
        )
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        now = stage(small.union(lowest.toDF("a", "b")).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.toDF("node", "root").union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum; equal marks mean a stable set."""
    return tuple(
        edges.select(F.xxhash64("a", "b").alias("h"))
        .agg(F.count("*"), F.bit_xor("h"), F.sum(F.shiftright("h", 20)))
        .first()
    )
