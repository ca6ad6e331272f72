"""Files a request is about, and code blocks split into active and background."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.functions.text import code_blocks, referenced_files
from ctxlens.operators.ranking import FileSets
from ctxlens.runtime import broadcast_if_small, stage

UNIT = ["request_id", "msg_idx", "part_idx"]


def referenced(msgs: DataFrame) -> DataFrame:
    """Distinct (request_id, file_key) named by user and system messages."""
    scanned = msgs.where(F.col("role").isin("user", "system") & (F.col("text") != ""))
    return scanned.select(
        "request_id", F.explode(referenced_files(F.col("text"))).alias("file_key")
    ).distinct()


def active_files(msgs: DataFrame, boosted: DataFrame | FileSets | None = None) -> DataFrame:
    """Named files, plus files a relevance score adds: `boosted(request_id, file_key)`.

    Boosted files as sets (by query_id) give (request_id, file_key, files): a row without file_key
    stands for as many boosted files that are not named.
    """
    named = referenced(msgs)
    if isinstance(boosted, FileSets):
        return _with_sets(stage(named, "named"), boosted)
    if boosted is None:
        return named
    return named.unionByName(boosted.select("request_id", "file_key")).distinct()


def _with_sets(named: DataFrame, boosted: FileSets) -> DataFrame:
    """See `active_files`. The sets are read once and never shuffled where few named files are in the corpus."""
    cell = ["request_id", "part"]
    placed = named.join(boosted.keys, "file_key").groupBy(*cell).agg(F.collect_list("place").alias("_named"))
    rows = boosted.rows.withColumnRenamed("query_id", "request_id").join(broadcast_if_small(placed), cell, "left")

    def is_set(place):
        byte = F.conv(F.hex(F.substring("places", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        return F.getbit(byte, (7 - place % 8).cast("int")).cast("bigint")

    also = F.aggregate("_named", F.lit(0).cast("bigint"), lambda n, place: n + is_set(place))
    others = F.when(F.col("file_key").isNull() & F.col("_named").isNotNull(), F.col("files") - also).otherwise(F.col("files"))
    listed = rows.select(
        "request_id", "file_key", F.when(F.col("file_key").isNull(), F.col("part")).alias("part"), others.alias("files")
    )
    plain = named.select("request_id", "file_key", F.lit(None).cast("int").alias("part"), F.lit(1).cast("bigint").alias("files"))
    return (
        listed.where(F.col("files") > 0).unionByName(plain)
        .groupBy("request_id", "file_key", "part").agg(F.max("files").alias("files")).drop("part")
    )


def blocks(units: DataFrame) -> DataFrame:
    """One row per fenced block of each text unit."""
    return units.where(F.col("text").contains("```")).select(
        *UNIT, F.inline(code_blocks(F.col("text")))
    )


def with_activity(block_rows: DataFrame, active: DataFrame) -> DataFrame:
    """blocks with `is_active`: no file name, or a file its request names."""
    marked = active.select("request_id", "file_key", F.lit(True).alias("_named"))
    return block_rows.join(marked, ["request_id", "file_key"], "left").withColumn(
        "is_active",
        F.col("filename").isNull()
        | ((F.col("file_key") != "") & F.coalesce("_named", F.lit(False))),
    ).drop("_named")


def block_counts(block_rows: DataFrame) -> DataFrame:
    """Per request: blocks and how many of them were reduced."""
    return block_rows.groupBy("request_id").agg(
        F.count("*").alias("total_blocks"),
        F.count_if("was_compressed").alias("skeletonized_blocks"),
    )
