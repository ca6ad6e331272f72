"""Commit logs exported as text: `COMMIT|<epoch>` followed by file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlens.functions.text import strip


def read_commit_log(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """commits(repo, path, commit_ts).

    The header word is the record separator, so each commit is one row and
    large logs split across tasks; no row depends on the one before it. A
    commit whose header is not a whole number is ignored with its files.
    """
    blocks = spark.read.option("lineSep", "COMMIT|").text(path)
    rows = F.split("value", "\n", -1)
    epoch = F.try_to_number(
        strip(F.split_part(F.get(rows, F.lit(0)), F.lit("|"), F.lit(1))),
        F.lit("S999999999999999"),
    ).cast("bigint")
    return (
        blocks.select(
            epoch.alias("epoch"),
            F.explode(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).alias("line"),
        )
        .where(F.col("epoch").isNotNull() & (strip(F.col("line")) != ""))
        .select(
            F.lit(repo).alias("repo"),
            strip(F.col("line")).alias("path"),
            F.timestamp_seconds("epoch").alias("commit_ts"),
        )
    )
