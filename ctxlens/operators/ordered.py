"""Ordered operators that stay spread out when one key holds much of the data.

A window over a key runs in one task per key. These operators cut each key into
slices of its order column, work inside a slice, and carry one summary row per
slice across. A slice depends only on the row's own value, so a lost executor's
work is redone with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens.runtime import stage


def last_before(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, span: int
) -> DataFrame:
    """Latest non-null `value` of an earlier row with the same keys.

    `order` is a whole-number column, `span` the width of a slice of it. Keys
    must not be null. Only slices after a key's first one need a carried value,
    so for keys that fit one slice the carry side is empty.
    """
    sliced = df.withColumn("_slice", F.col(order) - F.pmod(order, F.lit(span)))
    inside = W.partitionBy(*keys, "_slice").orderBy(order)
    local = sliced.withColumn(
        "_local",
        F.last(value, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, -1)),
    )
    summary = sliced.groupBy(*keys, "_slice").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end")
    )
    across = W.partitionBy(*keys).orderBy("_slice")
    carry = (
        summary.withColumn(
            "_carry",
            F.last("_end", ignorenulls=True).over(
                across.rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .where(F.col("_carry").isNotNull())
        .select(*keys, "_slice", "_carry")
    )
    return (
        local.join(carry, [*keys, "_slice"], "left")
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_slice", "_local", "_carry")
    )


def nth_latest(
    df: DataFrame, keys: list[str], order: str, n: int, out: str
) -> DataFrame:
    """Per key the order value of the n-th latest row; keys with fewer rows are absent.

    Both forms reduce before the shuffle: a maximum by partial aggregation, the
    general case by Spark's per-group row limit.
    """
    if n == 1:
        return df.groupBy(*keys).agg(F.max(order).alias(out))
    ranked = df.select(
        *keys,
        F.col(order).alias(out),
        F.row_number()
        .over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
        .alias("_rank"),
    )
    top = ranked.where(F.col("_rank") <= n)
    return top.where(F.col("_rank") == n).select(*keys, out)


def last_positions(residues: int, position: str, value: Column) -> list[Column]:
    """Aggregates for the values at the last `residues` positions of a group.

    Positions run 0, 1, 2, ... without gaps, so the last k of them are the
    greatest of each residue class modulo k. Each is a plain aggregate with a
    partial step; no group is brought together.
    """
    return [
        F.max_by(value, F.when(F.col(position) % residues == r, F.col(position)))
        for r in range(residues)
    ]


def ranks(df: DataFrame, keys: list[str], order: list[str], out: str, first: int = 1) -> DataFrame:
    """`df` with each row's place among the rows of its keys, counted from `first`.

    Rows are laid out by ranges of keys and order, so one key, or one value of its first
    order columns, takes as many tasks as its rows fill; the last order column should
    tell rows apart. A row's place is its place in its own range plus the rows of its key
    in earlier ranges: a prefix sum over one row per key and range. Without keys the
    whole table is numbered. Keys must not be null. The order columns sort as they do in
    `orderBy`. Equal rows are numbered in any order.
    """
    by = [F.col(c) for c in (*keys, *order)]
    laid = stage(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}),
        "laid",
    )
    sums = laid.groupBy(*keys, "_range").agg(F.min("_row").alias("_least"), F.count("*").alias("_n"))
    along = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # Written, so that its size is known and a large one is joined where Spark can split hot keys.
    offsets = stage(
        sums.select(
            *keys, "_range", (F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_least") + first).alias("_offset")
        ),
        "offsets",
    )
    return (
        laid.join(offsets, [*keys, "_range"])
        .withColumn(out, F.col("_row") + F.col("_offset"))
        .drop("_range", "_row", "_offset")
    )
