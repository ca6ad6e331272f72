"""How much of a request's opening its session's previous request already had.

Each message gets a chained hash, of its own role and text and of the hash before it, so
two requests share a message and all before it if the hashes at its place are equal. A
request meets the one before it in its session by their numbers there, which come from
a prefix sum over ranges; no session is brought together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.operators.cache_plan import prefix_estimate
from ctxlens.operators.ordered import ranks
from ctxlens.runtime import stage


def _chained(hashes: Column) -> Column:
    """Running hash over a list of hashes: each place stands for all up to it."""
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("all"))

    def add(done: Column, one: Column) -> Column:
        last = F.sha2(F.concat(done["last"], one), 256)
        return F.struct(last.alias("last"), F.concat(done["all"], F.array(last)).alias("all"))

    return F.aggregate(hashes, start, add, lambda done: done["all"])


def chains(msgs: DataFrame) -> DataFrame:
    """(request_id, chain, chars): chained hashes and lengths of each request's messages, in order.

    `msgs` has request_id, msg_idx, role and text; a null role or text differs from an empty
    one. One row holds the hashes of one request.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    own = F.sha2(F.concat_ws("\x1f", F.sha2(part("role"), 256), F.sha2(part("text"), 256)), 256)
    row = F.struct("msg_idx", own.alias("own"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    rows = msgs.groupBy("request_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return rows.select("request_id", _chained(F.col("_rows.own")).alias("chain"), F.col("_rows.n").alias("chars"))


def prefix_reuse(msgs: DataFrame, order: DataFrame) -> DataFrame:
    """What each request can take from the prompt cache that the request before it left.

    `order` has request_id, session_id and ts; ties go by request_id, which must be unique.
    Returns request_id, session_id, turn (from 1), previous_id, n_messages, common_messages
    (equal opening messages of both), reused_messages (those that the previous request's
    cached prefix covers) and reused_tokens. The first request of a session reuses nothing;
    requests without a session or messages are left out.
    """
    numbered = ranks(
        order.where(F.col("session_id").isNotNull()).select("request_id", "session_id", "ts"),
        ["session_id"], ["ts", "request_id"], "turn",
    )
    counted = msgs.select("request_id", "msg_idx", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    cached = prefix_estimate(counted).select("request_id", (F.col("prefix_end_index") + 1).alias("covered"))
    # Written once: both sides of the join come from it, and Spark can split it.
    rows = stage(numbered.join(chains(msgs), "request_id").join(cached, "request_id"), "chains")
    before = rows.select(
        "session_id", (F.col("turn") + 1).alias("turn"), F.col("request_id").alias("previous_id"),
        F.col("chain").alias("_chain"), F.col("covered").alias("_covered"),
    )
    both = rows.drop("covered").join(before, ["session_id", "turn"], "left")
    equal = F.zip_with("chain", "_chain", lambda a, b: F.coalesce((a == b).cast("bigint"), F.lit(0)))
    common = F.coalesce(F.aggregate(equal, F.lit(0).cast("bigint"), lambda n, x: n + x), F.lit(0).cast("bigint"))
    met = both.withColumn("common_messages", common).withColumn(
        "reused_messages", F.coalesce(F.least("common_messages", "_covered"), F.lit(0))
    )
    chars = F.aggregate(
        F.slice("chars", F.lit(1), F.col("reused_messages").cast("int")), F.lit(0).cast("bigint"), lambda n, x: n + x
    )
    return met.select(
        "request_id", "session_id", "turn", "previous_id", F.size("chain").cast("bigint").alias("n_messages"),
        "common_messages", "reused_messages",
        F.floor(chars / fv.CHARS_PER_TOKEN).cast("bigint").alias("reused_tokens"),
    )
