"""Which tool results were superseded by a later read of the same file.

Input is `tool_events(request_id, pos, kind use|result, tool_id, file)`; `pos`
is unique within a request and texts are not part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.operators.ordered import last_before, nth_latest

SLICE_SPAN = 1 << 42


def _keyed(events: DataFrame) -> DataFrame:
    """Missing ids match each other, so they become a key of their own."""
    return events.withColumn("_no_id", F.col("tool_id").isNull()).withColumn(
        "_id", F.coalesce("tool_id", F.lit(""))
    )


def result_files(
    events: DataFrame, span: int = SLICE_SPAN, tool_names: list[str] | None = None
) -> DataFrame:
    """Results with the file of the latest earlier call that has the same id.

    Calls without a file are skipped over and do not clear an id. `tool_names`
    restricts which tools count as reads (all by default).
    """
    if tool_names is not None:
        events = events.where(
            (F.col("kind") == "result") | F.col("tool_name").isin(tool_names)
        )
    found = last_before(
        _keyed(events).withColumn(
            "_use_file", F.when(F.col("kind") == "use", F.col("file"))
        ),
        ["request_id", "_no_id", "_id"], "pos", "_use_file", "read_file", span,
    )
    return found.where(
        (F.col("kind") == "result") & F.col("read_file").isNotNull()
    ).select("request_id", "pos", "tool_id", F.col("read_file").alias("file"))


def final_files(events: DataFrame) -> DataFrame:
    """File of the last call per id after the whole walk: names the file in notes."""
    uses = _keyed(events).where((F.col("kind") == "use") & F.col("file").isNotNull())
    return uses.groupBy("request_id", "_no_id", "_id").agg(
        F.max_by("file", "pos").alias("note_file")
    )


def stale_reads(results: DataFrame, keep_last: int = 1) -> DataFrame:
    """results(request_id, pos, file) with `is_stale`.

    A result is stale when `keep_last` later results exist for its file in its
    request. The cutoff per file is a pre-aggregated table joined back on; a hot
    file splits in that join.
    """
    if keep_last < 1:
        raise ValueError("keep_last must be 1 or more")
    cutoffs = nth_latest(results, ["request_id", "file"], "pos", keep_last, "cutoff")
    return results.join(cutoffs, ["request_id", "file"], "left").select(
        *results.columns,
        F.coalesce(F.col("pos") < F.col("cutoff"), F.lit(False)).alias("is_stale"),
    )


def stale_results(
    events: DataFrame,
    keep_last: int = 1,
    span: int = SLICE_SPAN,
    tool_names: list[str] | None = None,
) -> DataFrame:
    """Stale results with the file their replacement note names."""
    stale = stale_reads(result_files(events, span, tool_names), keep_last).where("is_stale")
    keyed = _keyed(stale.select("request_id", "pos", "tool_id"))
    return keyed.join(
        final_files(events), ["request_id", "_no_id", "_id"], "left"
    ).select("request_id", "pos", "note_file")
