"""Streaming queries: events as an arriving request log, driven until it is drained.

Each query writes its source, output and state below the session's checkpoint
folder, in a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ctxlens import adapters as ad
from ctxlens.catalog import Catalog
from ctxlens.catalog.bodies import EDIT, METRICS, PRICES, REQ
from ctxlens.catalog.traffic import GAP, RUNS
from ctxlens.runtime import ensure_checkpoint_dir
from ctxlens.sources.pricing import default_pricing
from ctxlens.streaming import totals, turns

CATALOG = Catalog()
BATCHES = 3


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def _arrivals(spark, sf, root: str):
    """events as a file stream that arrives in time order, a few files per batch."""
    events = ad.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _in_steps(spark, events, root)


def _in_steps(spark, events, root: str):
    """The rows as a file stream that arrives in the order of `ts`, in `BATCHES` steps."""
    span = events.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    width = (span.hi - span.lo) // BATCHES + 1
    part = F.floor((F.unix_micros("ts") - span.lo) / width)
    for i in range(BATCHES):
        events.where(part == i).write.mode("append").parquet(f"{root}/in/step={i}")
    files = spark.read.parquet(f"{root}/in/step=0").schema
    most = max(
        spark.read.parquet(f"{root}/in/step={i}").inputFiles().__len__() for i in range(BATCHES)
    )
    return spark.readStream.schema(files).option("maxFilesPerTrigger", most).parquet(f"{root}/in/*")


def _drain(writer, root: str):
    query = writer.option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()


@CATALOG.add(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS model, CAST(count(*) AS BIGINT) AS requests,
    CAST(sum(event_id % 500 + 7) AS BIGINT) AS original_tokens, CAST(sum(event_id % 300 + 7) AS BIGINT) AS compressed_tokens,
    CAST(sum(event_id % 500 - event_id % 300) AS BIGINT) AS tokens_saved FROM events
    GROUP BY 1, 2"""
)
def stream_totals(spark, sf):
    """Totals of events as requests whose tokens are known."""
    root = _folder(spark, "totals")
    e = F.col("event_id")
    metrics = _arrivals(spark, sf, root).select(
        "ts",
        F.col("event_type").alias("model"),
        (e % 500 + 7).alias("original_tokens"),
        (e % 300 + 7).alias("compressed_tokens"),
        F.lit(0.0).alias("cost_saved"),
    )
    _drain(metrics.writeStream.foreachBatch(totals.totals_writer(f"{root}/out", "model")), root)
    return totals.windowed_totals(spark, f"{root}/out", "model").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "model", "requests", "original_tokens", "compressed_tokens", "tokens_saved",
    )


@CATALOG.add(
    f"""WITH {PRICES}, {REQ}, {EDIT}, {METRICS} SELECT time_bucket(INTERVAL 1 DAY, ts AT TIME ZONE 'UTC') AS window_start, metrics.model,
    CAST(count(*) AS BIGINT) AS requests, CAST(sum(original_tokens) AS BIGINT) AS original_tokens,
    CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens, CAST(sum(original_tokens - compressed_tokens) AS BIGINT) AS tokens_saved,
    round(sum((original_tokens / 1e6 - compressed_tokens / 1e6) * coalesce(p_in, 3.0)), 8) AS cost_saved
    FROM metrics LEFT JOIN prices ON prices.model = metrics.model GROUP BY 1, 2"""
)
def stream_savings(spark, sf):
    """Logged requests with their bodies, compacted batch by batch; the last batch is given twice."""
    root = _folder(spark, "savings")
    stream = _in_steps(spark, ad.request_bodies(spark, sf), root)
    write = totals.savings_writer(f"{root}/out", default_pricing(spark), "model", width="1 day")

    def twice(batch, batch_id):
        write(batch, batch_id)
        if batch_id == BATCHES - 1:
            write(batch, batch_id)

    _drain(stream.writeStream.foreachBatch(twice), root)
    return totals.windowed_totals(spark, f"{root}/out", "model").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "model", "requests", "original_tokens", "compressed_tokens", "tokens_saved",
        F.round("cost_saved", 8).alias("cost_saved"),
    )


@CATALOG.add(
    f"""WITH {RUNS} SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, CAST(count(*) AS BIGINT) AS turn_count
    FROM runs GROUP BY user_id, run"""
)
def stream_sessions(spark, sf):
    root = _folder(spark, "sessions")
    stream = _arrivals(spark, sf, root).select("user_id", "ts")
    write = totals.session_writer(f"{root}/out", "user_id", "ts", GAP)
    _drain(stream.writeStream.foreachBatch(write), root)
    out = totals.session_totals(spark, f"{root}/out", "user_id", GAP)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@CATALOG.add(
    f"""WITH {RUNS} SELECT user_id, event_id,
    CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS turn_count FROM runs"""
)
def stream_turns(spark, sf):
    root = _folder(spark, "turns")
    stream = _arrivals(spark, sf, root).select("user_id", "event_id", "ts")
    numbered = turns.turn_stream(stream, "user_id", "ts", "event_id", GAP)
    _drain(numbered.writeStream.format("parquet").option("path", f"{root}/out"), root)
    return spark.read.schema(numbered.schema).parquet(f"{root}/out").select("user_id", "event_id", "turn_count")


@CATALOG.add("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def stream_recent(spark, sf):
    root = _folder(spark, "recent")
    stream = _arrivals(spark, sf, root).select("event_id", "ts", "user_id")
    _drain(stream.writeStream.foreachBatch(turns.recent_writer(f"{root}/out", "ts", "event_id")), root)
    last = spark.read.parquet(f"{root}/out").agg(F.max("batch").alias("b")).first().b
    return spark.read.parquet(f"{root}/out/batch={last}").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
