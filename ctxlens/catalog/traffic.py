"""Queries on the large fact tables: tool reads, sessions, recent requests, costs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ctxlens import adapters as ad
from ctxlens.catalog import Catalog
from ctxlens.catalog.chats import PRICES
from ctxlens.operators import accounting, sessions, tool_reads
from ctxlens.runtime import ensure_checkpoint_dir
from ctxlens.sources.pricing import default_pricing, read_pricing
from ctxlens.sources.sinks import append_once, read_facts

CATALOG = Catalog()
GAP = 6 * 3600


# --- tool reads -----------------------------------------------------------------------

READS = """reads AS (SELECT l_orderkey AS request_id, CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 100000000000
    + l_suppkey * 100000 + date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS pos,
  l_partkey % 50 AS file FROM lineitem)"""


def _stale_sql(n: int) -> str:
    return f"""WITH {READS} SELECT request_id, pos, file,
    row_number() OVER (PARTITION BY request_id, file ORDER BY pos DESC) > {n} AS is_stale FROM reads"""


@CATALOG.add(_stale_sql(1))
def stale_reads(spark, sf):
    return tool_reads.stale_reads(ad.line_item_reads(spark, sf))


@CATALOG.add(_stale_sql(2))
def stale_reads_keep_two(spark, sf):
    return tool_reads.stale_reads(ad.line_item_reads(spark, sf), keep_last=2)


ASOF = f"""
{ad.EVENT_TRAFFIC_SQL},
walk AS (SELECT *, last_value(file IGNORE NULLS) OVER (PARTITION BY request_id, tool_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS read_file FROM traffic),
results AS (SELECT request_id, pos, tool_id, read_file AS file FROM walk WHERE kind = 'result' AND read_file IS NOT NULL)"""


@CATALOG.add(f"WITH {ASOF} SELECT * FROM results")
def tool_asof(spark, sf):
    return tool_reads.result_files(ad.event_tool_traffic(spark, sf), span=1024)


@CATALOG.add(
    f"""WITH {ad.EVENT_TRAFFIC_SQL} SELECT request_id, tool_id, max_by(file, pos) AS note_file
    FROM traffic WHERE kind = 'use' AND file IS NOT NULL GROUP BY 1, 2"""
)
def tool_file(spark, sf):
    rows = tool_reads.final_files(ad.event_tool_traffic(spark, sf))
    return rows.select(
        "request_id", F.when(~F.col("_no_id"), F.col("_id")).alias("tool_id"), "note_file"
    )


@CATALOG.add(
    f"""WITH {ASOF},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, file ORDER BY pos DESC) AS n FROM results),
    notes AS (SELECT request_id, tool_id, max_by(file, pos) AS note_file FROM traffic
              WHERE kind = 'use' AND file IS NOT NULL GROUP BY 1, 2)
    SELECT ranked.request_id, pos, note_file FROM ranked LEFT JOIN notes
    ON notes.request_id = ranked.request_id AND notes.tool_id IS NOT DISTINCT FROM ranked.tool_id WHERE n > 2"""
)
def stale_results(spark, sf):
    return tool_reads.stale_results(ad.event_tool_traffic(spark, sf), keep_last=2, span=1024)


# --- sessions ---------------------------------------------------------------------------

RUNS = f"""
gaps AS (SELECT user_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idle FROM events),
runs AS (SELECT *, sum(CASE WHEN idle IS NULL OR idle > {GAP}000000 THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM gaps)"""


def _timed_events(spark, sf):
    return ad.table(spark, sf, "events").select("user_id", "event_id", "ts")


@CATALOG.add(
    f"""WITH {RUNS} SELECT user_id, CAST(run AS BIGINT) AS run, min(ts) AS first_seen, max(ts) AS last_seen,
    CAST(count(*) AS BIGINT) AS turn_count FROM runs GROUP BY 1, 2"""
)
def session_runs(spark, sf):
    runs = sessions.session_runs(_timed_events(spark, sf), "user_id", "ts", GAP)
    return runs.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")}
    )


@CATALOG.add(
    f"""WITH {RUNS} SELECT user_id, event_id, ts, CAST(run AS BIGINT) AS run,
    CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS turn_count FROM runs"""
)
def turn_count(spark, sf):
    return sessions.turn_counts(_timed_events(spark, sf), "user_id", "ts", "event_id", GAP)


# --- recent requests -----------------------------------------------------------------------

RECENT = "event_id, ts, user_id, event_type, value"


@CATALOG.add(f"SELECT {RECENT} FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_requests(spark, sf):
    events = ad.table(spark, sf, "events").drop("props")
    return accounting.recent(events, "ts", "event_id")


@CATALOG.add(
    f"""SELECT {RECENT}, CAST(n AS INT) AS recency_no FROM (SELECT *, row_number() OVER
    (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50"""
)
def recent_by_type(spark, sf):
    events = ad.table(spark, sf, "events").drop("props")
    return accounting.recent_by(events, "event_type", "ts", "event_id")


@CATALOG.add(
    f"""SELECT {RECENT} FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""
)
def latest_request(spark, sf):
    events = ad.table(spark, sf, "events").drop("props")
    return accounting.latest(events, "user_id", "ts", "event_id").select(
        "event_id", "ts", "user_id", "event_type", "value"
    )


# --- costs of a large log ---------------------------------------------------------------------

ORDER_MODELS = {
    "1-URGENT": "claude-3-opus-20240229",
    "2-HIGH": "gpt-4o",
    "3-MEDIUM": "gpt-4o-mini",
    "4-NOT SPECIFIED": "unlisted-model",
    "5-LOW": "gpt-3.5-turbo",
}


@CATALOG.add(
    f"""WITH {PRICES}, per AS (SELECT l_orderkey AS k, CAST(sum(4 + CAST(floor(l_quantity) AS BIGINT)) + 3 AS BIGINT) AS o,
      CAST(sum(4 + CASE WHEN l_returnflag = 'N' THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END) + 3 AS BIGINT) AS c FROM lineitem GROUP BY 1),
    req AS (SELECT CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ORDER_MODELS.items())} END AS model,
      CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o, c FROM orders JOIN per ON k = o_orderkey)
    SELECT req.model, day, CAST(count(*) AS BIGINT) AS requests, CAST(sum(o) AS BIGINT) AS original_tokens,
    CAST(sum(c) AS BIGINT) AS compressed_tokens, CAST(sum(o) - sum(c) AS BIGINT) AS tokens_saved,
    round(sum((o / 1e6 - c / 1e6) * coalesce(p_in, 3.0)), 8) AS cost_saved
    FROM req LEFT JOIN prices ON prices.model = req.model GROUP BY 1, 2"""
)
def cost_by_model_and_day(spark, sf):
    """orders as requests, lineitem as their messages."""
    quantity = F.floor("l_quantity").cast("bigint")
    tokens = ad.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        (F.sum(4 + quantity) + 3).cast("bigint").alias("original_tokens"),
        (F.sum(4 + F.when(F.col("l_returnflag") == "N", quantity).otherwise(0)) + 3)
        .cast("bigint").alias("compressed_tokens"),
    )
    names = F.create_map(*[F.lit(x) for kv in ORDER_MODELS.items() for x in kv])
    requests = ad.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.try_element_at(names, F.col("o_orderpriority")).alias("model"),
        F.to_date("o_orderdate").cast("string").alias("day"),
    ).join(tokens, "l_orderkey")
    costs = accounting.request_costs(requests, default_pricing(spark))
    return accounting.totals(costs, "model", "day").select(
        "model", "day", "requests", "original_tokens", "compressed_tokens", "tokens_saved",
        F.round("cost_saved", 8).alias("cost_saved"),
    )


# --- files read and written -----------------------------------------------------------


@CATALOG.add(
    """SELECT 'p' || p_partkey AS model, CASE WHEN p_partkey % 7 = 0 THEN 3.0 ELSE CAST(p_size AS DOUBLE) END AS input,
    CASE WHEN p_partkey % 11 = 0 THEN 15.0 ELSE p_retailprice END AS output FROM part"""
)
def price_file(spark, sf):
    """part as a price list with gaps, which take the default price."""
    where = f"{ensure_checkpoint_dir(spark)}/prices-{uuid.uuid4().hex}"
    key = F.col("p_partkey")
    ad.table(spark, sf, "part").select(
        F.concat(F.lit("p"), key).alias("model"),
        F.when(key % 7 != 0, F.col("p_size").cast("double")).alias("input"),
        F.when(key % 11 != 0, F.col("p_retailprice")).alias("output"),
    ).write.option("header", "true").csv(where)
    return read_pricing(spark, where)


@CATALOG.add(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS facts, CAST(sum(event_id) AS BIGINT) AS ids,
    round(sum(value), 4) AS total FROM events GROUP BY 1"""
)
def daily_facts(spark, sf):
    """events appended to a table by day in two parts, one of them twice, and read back."""
    where = f"{ensure_checkpoint_dir(spark)}/facts-{uuid.uuid4().hex}"
    facts = ad.table(spark, sf, "events").select("event_id", "ts", "value")
    for part in (0, 1, 1):
        append_once(facts.where(F.col("event_id") % 2 == part), where, f"half-{part}")
    return read_facts(spark, where).groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("facts"), F.sum("event_id").alias("ids"),
        F.round(F.sum("value"), 4).alias("total"),
    )
