"""Totals and sessions of a stream, kept as parts that add up.

A batch adds what its own rows come to as a part of a table (`sources.parts`), under its
number, so a batch that runs again counts once. A row that arrives late counts where its
event time belongs, the latest window and session are there at once, and nothing is
dropped or held in executor state. Parts are merged by levels, so readers open few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.operators import accounting
from ctxlens.operators.sessions import session_runs
from ctxlens.plans.compaction import Options, compact
from ctxlens.sources.parts import Parts
from ctxlens.sources.request_log import parse_bodies

SUMS = ["requests", "original_tokens", "compressed_tokens", "cost_saved"]


def _put(folder: str, part: DataFrame, source: str, batch_id: int, combine: Callable) -> None:
    parts = Parts(part.sparkSession, folder)
    parts.append(part, f"{source}-{batch_id}")
    parts.merge(combine)


def _totals(rows: DataFrame, *by: str, width: str) -> DataFrame:
    return (
        rows.withColumn("requests", F.lit(1).cast("bigint"))
        .groupBy(F.window("ts", width), *by)
        .agg(*[F.sum(c).alias(c) for c in SUMS])
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *by, *SUMS,
        )
    )


def _added(*by: str) -> Callable[[DataFrame], DataFrame]:
    return lambda parts: parts.groupBy("window_start", "window_end", *by).agg(*[F.sum(c).alias(c) for c in SUMS])


def totals_writer(
    folder: str, *by: str, width: str = "1 hour", source: str = "batch"
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: requests, tokens and savings per window and `by`.

    Batches are known by `source` and number: a query with new checkpoints needs a source
    of its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _put(folder, _totals(batch, *by, width=width), source, batch_id, _added(*by))

    return write


def savings_writer(
    folder: str,
    prices: DataFrame,
    *by: str,
    width: str = "1 hour",
    source: str = "batch",
    options: Options = Options(),
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over logged requests with their bodies, as `read_log` gives them.

    Each batch is compacted as a log of its own; what its requests come to before and after is
    added per window and `by`. Requests that are passed through are not metered. A batch that
    is there already is not compacted again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if Parts(batch.sparkSession, folder).has(f"{source}-{batch_id}"):
            return
        metrics = compact(parse_bodies(batch), options).request_metrics()
        costs = accounting.request_costs(metrics, prices)
        _put(folder, _totals(costs, *by, width=width), source, batch_id, _added(*by))

    return write


def windowed_totals(spark: SparkSession, folder: str, *by: str) -> DataFrame:
    """All windows so far, from the parts that a writer of totals has added."""
    return _added(*by)(Parts(spark, folder).read()).withColumn(
        "tokens_saved", F.col("original_tokens") - F.col("compressed_tokens")
    )


def session_writer(
    folder: str, key: str, ts: str, gap_seconds: int = fv.SESSION_GAP_SECONDS, source: str = "batch"
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the session runs among the rows of each batch.

    A hot session is summed in time slices before its rows meet (`session_runs`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        runs = session_runs(batch, key, ts, gap_seconds).drop("run")
        _put(folder, runs, source, batch_id, lambda parts: _joined_runs(parts, key, gap_seconds))

    return write


def session_totals(
    spark: SparkSession, folder: str, key: str, gap_seconds: int = fv.SESSION_GAP_SECONDS
) -> DataFrame:
    """(key, first_seen, last_seen, turn_count) of all runs so far."""
    return _joined_runs(Parts(spark, folder).read(), key, gap_seconds)


def _joined_runs(parts: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Runs of several parts as runs of all.

    Rows of one part's run lie at most a gap apart, so runs of several parts are
    one if they overlap or lie at most a gap apart. Only these summaries are sorted.
    """
    lo, hi = F.unix_micros("first_seen"), F.unix_micros("last_seen")
    order = W.partitionBy(key).orderBy("first_seen", "last_seen")
    reached = F.max(hi).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce((lo - reached > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    return (
        parts.withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(key, "_run")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.sum("turn_count").alias("turn_count"),
        )
        .drop("_run")
    )
