"""Tokens and cost of requests, files, models and time spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.functions.tokens import compression_ratio, cost_usd
from ctxlens.runtime import broadcast_if_small


def request_tokens(msgs: DataFrame, tokens: Column, out: str = "tokens") -> DataFrame:
    """Sum of (4 + tokens of a message) plus 3, per request."""
    return msgs.groupBy("request_id").agg(
        (F.sum(fv.TOKENS_PER_MESSAGE + tokens) + fv.TOKENS_PER_REPLY).cast("bigint").alias(out)
    )


def with_prices(df: DataFrame, pricing: DataFrame, model: str = "model") -> DataFrame:
    """Input and output price by exact model name, else `default`, else 3 / 15."""
    base = pricing.where(F.col("model") == "default")
    priced = pricing.select(
        F.col("model").alias(model),
        F.col("input").alias("_in"),
        F.col("output").alias("_out"),
    )
    fallback = [base.agg(F.max(c)).scalar() for c in ("input", "output")]
    return (
        df.join(broadcast_if_small(priced), model, "left")
        .withColumn("price_in", F.coalesce("_in", fallback[0], F.lit(fv.DEFAULT_PRICE[0])))
        .withColumn("price_out", F.coalesce("_out", fallback[1], F.lit(fv.DEFAULT_PRICE[1])))
        .drop("_in", "_out")
    )


def request_costs(metrics: DataFrame, pricing: DataFrame) -> DataFrame:
    """metrics(…, model, original_tokens, compressed_tokens) with cost and savings."""
    before, after = F.col("original_tokens"), F.col("compressed_tokens")
    return (
        with_prices(metrics, pricing)
        .withColumn("tokens_saved", before - after)
        .withColumn("compression_ratio", compression_ratio(before, after))
        .withColumn("original_cost", cost_usd(before, F.col("price_in")))
        .withColumn("compressed_cost", cost_usd(after, F.col("price_in")))
        .withColumn("cost_saved", F.col("original_cost") - F.col("compressed_cost"))
        .drop("price_in", "price_out")
    )


def totals(metrics: DataFrame, *by: str) -> DataFrame:
    """Requests, tokens, savings and covered time, over all rows or by columns."""
    before, after = F.col("original_tokens"), F.col("compressed_tokens")
    aggs = [
        F.count("*").alias("requests"),
        F.sum("original_tokens").alias("original_tokens"),
        F.sum("compressed_tokens").alias("compressed_tokens"),
        F.sum("cost_saved").alias("cost_saved"),
    ]
    if "ts" in metrics.columns:
        aggs += [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")]
    return (
        metrics.groupBy(*by)
        .agg(*aggs)
        .withColumn("tokens_saved", before - after)
        .withColumn("compression_ratio", compression_ratio(before, after))
    )


def savings_rollup(metrics: DataFrame, *by: str) -> DataFrame:
    """Savings at every level of `by`; rolled-up columns are null."""
    before, after = F.col("original_tokens"), F.col("compressed_tokens")
    return (
        metrics.rollup(*by)
        .agg(
            F.sum("original_tokens").alias("original_tokens"),
            F.sum("compressed_tokens").alias("compressed_tokens"),
            F.grouping_id().cast("bigint").alias("level"),
        )
        .withColumn("tokens_saved", before - after)
        .withColumn("compression_ratio", compression_ratio(before, after))
    )


def health(metrics: DataFrame) -> DataFrame:
    """One row: requests processed and tokens saved."""
    return metrics.agg(
        F.count("*").alias("requests_processed"),
        F.coalesce(
            F.sum(F.col("original_tokens") - F.col("compressed_tokens")), F.lit(0)
        ).cast("bigint").alias("tokens_saved"),
    )


def recent(df: DataFrame, ts: str, tie: str, n: int = fv.RECENT_REQUESTS) -> DataFrame:
    """The last `n` requests overall, by a distributed top-n."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def recent_by(
    df: DataFrame, by: str, ts: str, tie: str, n: int = fv.RECENT_REQUESTS
) -> DataFrame:
    """The last `n` requests per `by`; each task passes on `n` rows per key at most."""
    order = W.partitionBy(by).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("recency_no", F.row_number().over(order)).where(
        F.col("recency_no") <= n
    )


def latest(df: DataFrame, by: str, ts: str, tie: str) -> DataFrame:
    """The one latest request per `by`, as an aggregate."""
    rest = [c for c in df.columns if c != by]
    return (
        df.groupBy(by)
        .agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_last"))
        .select(by, "_last.*")
    )


def file_stats(block_rows: DataFrame) -> DataFrame:
    """Per block: file, tokens before and after, whether it was reduced.

    Uses the character counts carried by the block table (four characters a
    token), so no code is read again.
    """
    before = F.floor(F.col("code_chars") / fv.CHARS_PER_TOKEN).cast("bigint")
    after = F.when(
        F.col("was_compressed"),
        F.floor(F.length("skeleton") / fv.CHARS_PER_TOKEN).cast("bigint"),
    ).otherwise(before)
    return block_rows.select(
        "request_id",
        F.coalesce("filename", F.lit("unknown")).alias("filename"),
        before.alias("original_tokens"),
        after.alias("compressed_tokens"),
        "was_compressed",
    )


def file_report(block_rows: DataFrame) -> DataFrame:
    """Savings per file name over a corpus of requests."""
    before, after = F.col("original_tokens"), F.col("compressed_tokens")
    return (
        file_stats(block_rows)
        .groupBy("filename")
        .agg(
            F.count("*").alias("blocks"),
            F.sum("original_tokens").alias("original_tokens"),
            F.sum("compressed_tokens").alias("compressed_tokens"),
            F.count_if("was_compressed").alias("skeletonized"),
        )
        .withColumn("tokens_saved", before - after)
        .withColumn("compression_ratio", compression_ratio(before, after))
    )
