"""Logs of LLM API requests: one JSON object per line or one row per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlens.functions import variants as V
from ctxlens.functions.once import once

LOG_SCHEMA = (
    "request_id STRING, ts TIMESTAMP, endpoint STRING, "
    "headers MAP<STRING,STRING>, body STRING, _corrupt_record STRING"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON-lines logs; `.gz`, `.zst` and `.deflate` files are decoded by Spark.

    `body` may be a JSON object or the request's raw text. A line that is not
    JSON is kept with its text in `_corrupt_record`.
    """
    return (
        spark.read.schema(LOG_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def parse_bodies(log: DataFrame, raw: str = "body") -> DataFrame:
    """Replace a text column by `body VARIANT` and a `corrupt` flag.

    An empty or missing text is the empty object. Text that is no JSON object
    gives `corrupt = true` and keeps its text in `raw_body`; it is not dropped, and
    neither is a log line that is not JSON.
    """
    text = F.when(F.coalesce(F.col(raw), F.lit("")) == "", "{}").otherwise(F.col(raw))
    kept = [c for c in log.columns if c not in (raw, "_corrupt_record")]
    line = (
        F.col("_corrupt_record") if "_corrupt_record" in log.columns else F.lit(None).cast("string")
    )
    parsed = log.select(
        *kept,
        F.coalesce(line, F.col(raw)).alias("raw_body"),
        line.isNotNull().alias("_unread"),
        once(F.try_parse_json(text)).alias("body"),
    )
    bad = F.col("_unread") | ~F.coalesce(V.is_object(F.col("body")), F.lit(False))
    return parsed.select(
        *kept,
        "body",
        bad.alias("corrupt"),
        F.when(bad, F.col("raw_body")).alias("raw_body"),
    )
