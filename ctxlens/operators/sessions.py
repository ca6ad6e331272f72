"""Session runs: a session's requests, cut wherever it was idle for too long.

Time is cut into slices as long as the allowed gap. Two requests of one slice are
always less than a gap apart, so a run never breaks inside a slice, and one
summary row per slice (first, last, count) decides all breaks. Only summaries
pass through per-session windows; their number is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.operators.ordered import ranks
from ctxlens.runtime import stage


def _timed(df: DataFrame, ts: str, gap_seconds: int) -> DataFrame:
    into = F.pmod("_us", F.lit(gap_seconds * 1_000_000))
    return df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_slice", F.col("_us") - into)


def _slices(timed: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """One row per session and slice with its run number."""
    sums = timed.groupBy(key, "_slice").agg(
        F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.count("*").alias("_n")
    )
    along = W.partitionBy(key).orderBy("_slice")
    idle = F.col("_lo") - F.lag("_hi").over(along)
    starts = sums.withColumn(
        "_start", (F.coalesce(idle > gap_seconds * 1_000_000, F.lit(True))).cast("bigint")
    )
    return starts.withColumn(
        "run", F.sum("_start").over(along.rowsBetween(W.unboundedPreceding, 0))
    )


def session_runs(
    df: DataFrame, key: str, ts: str, gap_seconds: int = fv.SESSION_GAP_SECONDS
) -> DataFrame:
    """runs(key, run, first_seen, last_seen, turn_count)."""
    return (
        _slices(_timed(df.select(key, ts), ts, gap_seconds), key, gap_seconds)
        .groupBy(key, "run")
        .agg(
            F.timestamp_micros(F.min("_lo")).alias("first_seen"),
            F.timestamp_micros(F.max("_hi")).alias("last_seen"),
            F.sum("_n").alias("turn_count"),
        )
    )


def turn_counts(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    gap_seconds: int = fv.SESSION_GAP_SECONDS,
) -> DataFrame:
    """Every request with its `run` and its 1-based `turn_count` in that run.

    A request without a key or a time belongs to no run and has the turn 0. Rows are numbered
    along time and `tie` by ranges, so a session may have any number of rows, also of
    one time stamp.
    """
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    timed = _timed(df.where(known), ts, gap_seconds)
    along = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    runs = _slices(timed.select(key, "_us", "_slice"), key, gap_seconds).withColumn(
        "_earlier", F.coalesce(F.sum("_n").over(along), F.lit(0))
    )
    # Written, so that Spark can split the join where one session has most rows.
    slices = stage(
        runs.select(key, "_slice", "run", F.min("_earlier").over(W.partitionBy(key, "run")).alias("_before")), "slices"
    )
    # A row's place in its run is its place in the session less the rows before the run.
    numbered = (
        ranks(timed, [key], ["_us", tie], "_place")
        .join(slices, [key, "_slice"])
        .withColumn("turn_count", F.col("_place") - F.col("_before"))
        .drop("_us", "_slice", "_place", "_before")
    )
    alone = df.where(~known).withColumn("turn_count", F.lit(0).cast("bigint"))
    return numbered.unionByName(alone, allowMissingColumns=True)


def cache_stats(plans: DataFrame, gap_seconds: int = fv.SESSION_GAP_SECONDS) -> DataFrame:
    """One row of totals over planned requests.

    `plans` has request_id, ts, session_id (null below the minimum size),
    breakpoints and cached_tokens_estimate.
    """
    marked = F.col("breakpoints") > 0
    totals = plans.agg(
        F.count_if(marked).alias("requests_with_breakpoints"),
        F.coalesce(F.sum("breakpoints"), F.lit(0)).cast("bigint").alias("breakpoints_injected"),
        F.coalesce(F.sum(F.when(marked, F.col("cached_tokens_estimate"))), F.lit(0))
        .cast("bigint")
        .alias("estimated_tokens_cached"),
    )
    runs = session_runs(
        plans.where(F.col("session_id").isNotNull()), "session_id", "ts", gap_seconds
    ).agg(F.count("*").alias("n"))
    return totals.withColumn("sessions_seen", runs.scalar())
