"""Request-body queries: parsing, policy, cache plans and whole compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ctxlens import adapters as ad
from ctxlens.catalog import Catalog
from ctxlens.catalog.chats import HEADER, PRICES
from ctxlens.functions import variants as V
from ctxlens.operators import accounting, cache_plan, messages, policy, sessions
from ctxlens.plans.compaction import Options, compact
from ctxlens.runtime import ensure_checkpoint_dir
from ctxlens.sources.pricing import default_pricing
from ctxlens.sources.request_log import parse_bodies, read_log
from ctxlens.sources.sinks import write_bodies

CATALOG = Catalog()

FILL = {**ad.HOLES_SQL, "header": f"'{HEADER}'"}
PY = ad.fill_sql(ad.PY_CODE, **FILL)
CODED = ad.fill_sql(ad.CODED, **FILL)

# What the adapter writes, said once more in SQL: one row per request.
REQ = f"""
req AS (
  SELECT conv_id || '-' || turn AS request_id, conv_id, turn, conv_id AS c, turn AS t, text, {CODED} AS coded, {PY} AS py,
         conv_id % 2 = 0 AS tools, conv_id % 5 AS sys, conv_id % 7 AS odd,
         CASE WHEN turn % 4 < 2 THEN 'messages' WHEN turn % 4 = 2 THEN 'chat' ELSE 'responses' END AS api,
         to_timestamp(1700000000 + conv_id * 600 + turn * 60) AS ts,
         CASE WHEN turn % 4 < 2 THEN {ad.MODEL_SQL} ELSE 'gpt-4o' END AS model,
         turn % 4 = 3 AND conv_id % 7 = 6 AS corrupt, turn % 4 = 3 AND conv_id % 7 = 4 AS hollow,
         turn % 4 = 3 AND conv_id % 7 = 5 AS plain_input
  FROM conversations)"""


def _parsed(spark, sf):
    return parse_bodies(ad.request_bodies(spark, sf))


def _requests(spark, sf):
    return messages.requests(_parsed(spark, sf))


# --- parsing -------------------------------------------------------------------------


@CATALOG.add(f"WITH {REQ} SELECT request_id, corrupt, CASE WHEN corrupt THEN '{{broken' END AS raw_body FROM req")
def log_parse(spark, sf):
    return _parsed(spark, sf).select("request_id", "corrupt", "raw_body")


@CATALOG.add(
    f"""WITH {REQ} SELECT request_id, CAST(turn AS INT) AS minute, corrupt, CASE WHEN corrupt THEN '{{broken' END AS raw_body FROM req
    UNION ALL SELECT NULL, NULL, true, 'no json ' || conv_id FROM conversations WHERE turn = 0"""
)
def log_file_parse(spark, sf):
    """The log as compressed JSON lines, some lines of it no JSON."""
    where = f"{ensure_checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    lines = ad.request_bodies(spark, sf).select(
        F.to_json(F.struct("request_id", "ts", "endpoint", "headers", "body")).alias("value")
    )
    odd = ad.table(spark, sf, "conversations").where("turn = 0").select(
        F.concat(F.lit("no json "), "conv_id").alias("value")
    )
    lines.unionByName(odd).write.option("compression", "gzip").text(where)
    conv = F.split_part("request_id", F.lit("-"), F.lit(1)).cast("bigint")
    minute = (F.unix_seconds("ts") - 1_700_000_000 - conv * 600) / 60
    return parse_bodies(read_log(spark, where)).select(
        "request_id", minute.cast("int").alias("minute"), "corrupt", "raw_body"
    )


@CATALOG.add(
    f"""WITH {REQ} SELECT request_id, api, model,
    CAST(CASE WHEN hollow THEN 0 WHEN api <> 'responses' THEN 6 WHEN plain_input THEN 1 ELSE 4 END AS INT) AS n_items
    FROM req WHERE NOT corrupt"""
)
def request_index(spark, sf):
    return _requests(spark, sf).select("request_id", "api", "model", F.size("items").alias("n_items"))


MESSAGES = f"""
msg AS (
  SELECT request_id, api, 0 AS msg_idx, 'user' AS role, text, 'string' AS content_kind, conv_id, turn FROM req WHERE api <> 'responses'
  UNION ALL SELECT request_id, api, 1, 'assistant', CASE WHEN tools THEN 'Reading' ELSE 'Working on it' END, CASE WHEN tools THEN 'list' ELSE 'string' END, conv_id, turn FROM req WHERE api <> 'responses'
  UNION ALL SELECT request_id, api, 2, 'user', CASE WHEN tools THEN '' ELSE 'go on' END, CASE WHEN tools THEN 'list' ELSE 'string' END, conv_id, turn FROM req WHERE api <> 'responses'
  UNION ALL SELECT request_id, api, 3, 'assistant', CASE WHEN tools THEN '' ELSE coded END, CASE WHEN tools THEN 'list' ELSE 'string' END, conv_id, turn FROM req WHERE api <> 'responses'
  UNION ALL SELECT request_id, api, 4, 'user', CASE WHEN tools THEN '' ELSE 'ok' END, CASE WHEN tools THEN 'list' ELSE 'string' END, conv_id, turn FROM req WHERE api <> 'responses'
  UNION ALL SELECT request_id, api, 5, 'user', coded, 'string', conv_id, turn FROM req WHERE api <> 'responses'
  UNION ALL SELECT request_id, api, -1, 'system', CASE sys WHEN 1 THEN '  ' WHEN 2 THEN 'Focus on g7.js' WHEN 3 THEN 'Focus on lib/f0.py please' ELSE 'a' END,
    CASE WHEN sys < 3 THEN 'string' ELSE 'list' END, conv_id, turn FROM req WHERE api = 'messages' AND sys > 0
  UNION ALL SELECT request_id, api, 0, 'user', coded, 'string', conv_id, turn FROM req WHERE api = 'responses' AND NOT corrupt AND NOT hollow
  UNION ALL SELECT request_id, api, 3, 'user', CASE WHEN odd = 3 THEN '' ELSE text END, CASE WHEN odd = 3 THEN 'list' ELSE 'string' END, conv_id, turn
    FROM req WHERE api = 'responses' AND NOT corrupt AND NOT hollow AND NOT plain_input)"""


@CATALOG.add(f"WITH {REQ}, {MESSAGES} SELECT request_id, api, CAST(msg_idx AS INT) AS msg_idx, role, text, content_kind FROM msg")
def message_rows(spark, sf):
    return messages.messages(_requests(spark, sf)).select(
        "request_id", "api", "msg_idx", "role", "text", "content_kind"
    )


@CATALOG.add(f"WITH {REQ}, {MESSAGES} SELECT request_id, role, text FROM msg WHERE msg_idx = -1")
def system_pseudo(spark, sf):
    return messages.messages(_requests(spark, sf)).where("detect_only").select(
        "request_id", "role", "text"
    )


@CATALOG.add(
    f"""WITH {REQ}, {MESSAGES} SELECT request_id, CAST(count(*) AS BIGINT) AS n_messages,
    bool_or(content_kind <> 'string') AS has_typed_parts FROM msg WHERE api = 'responses' GROUP BY 1"""
)
def responses_normalise(spark, sf):
    rows = messages.messages(_requests(spark, sf).where("api = 'responses'"))
    return rows.groupBy("request_id").agg(
        F.count("*").alias("n_messages"),
        F.bool_or(F.col("content_kind") != "string").alias("has_typed_parts"),
    )


@CATALOG.add(
    f"""WITH {REQ}, p AS (
      SELECT request_id, 1 AS msg_idx, 0 AS part_idx, 'text' AS type, 'Reading' AS text, NULL AS tool, NULL AS file, NULL AS result FROM req WHERE api <> 'responses' AND tools
      UNION ALL SELECT request_id, 1, 1, 'tool_use', NULL, 't1', 'lib/f' || (c % 3) || '.py', NULL FROM req WHERE api <> 'responses' AND tools
      UNION ALL SELECT request_id, 2, 0, 'tool_result', NULL, 't1', NULL, py FROM req WHERE api <> 'responses' AND tools
      UNION ALL SELECT request_id, 3, 0, 'tool_use', NULL, 't2', 'lib/f' || (c % 3) || '.py', NULL FROM req WHERE api <> 'responses' AND tools
      UNION ALL SELECT request_id, 4, 0, 'tool_result', NULL, 't2', NULL, py FROM req WHERE api <> 'responses' AND tools
      UNION ALL SELECT request_id, 3, 0, 'input_text', text, NULL, NULL, NULL FROM req WHERE api = 'responses' AND odd = 3)
    SELECT request_id, CAST(msg_idx AS INT) AS msg_idx, CAST(part_idx AS INT) AS part_idx, type, text, tool, file, result FROM p"""
)
def part_rows(spark, sf):
    from ctxlens.functions.text import file_from_tool_input

    rows = messages.parts(messages.messages(_requests(spark, sf)))
    return rows.select(
        "request_id", "msg_idx", "part_idx", "type", "text",
        F.coalesce("tool_id", "tool_use_id").alias("tool"),
        file_from_tool_input(F.col("tool_input")).alias("file"),
        F.coalesce("result_text", F.get("result_blocks", F.lit(0)).getField("text")).alias("result"),
    )


# --- policy and routing ----------------------------------------------------------------

HAS_TOOLS = "(tools AND NOT hollow AND NOT plain_input)"
POLICY = f"""CASE WHEN api = 'responses' THEN CASE WHEN odd = 3 THEN 'none' ELSE 'plain' END
  WHEN {HAS_TOOLS} THEN 'tool_aware' ELSE 'plain' END"""


@CATALOG.add(f"WITH {REQ} SELECT request_id, {HAS_TOOLS} AS has_tools FROM req WHERE NOT corrupt")
def has_tools(spark, sf):
    return policy.request_policy(_requests(spark, sf)).select("request_id", "has_tools")


@CATALOG.add(
    f"""WITH {REQ} SELECT request_id, {POLICY} AS policy,
    CASE WHEN {HAS_TOOLS} THEN 'none' ELSE {POLICY} END AS policy_without_tools,
    'none' AS policy_passthrough FROM req WHERE NOT corrupt""",
    name="policy",
)
def _policy(spark, sf):
    rows = policy.request_policy(_requests(spark, sf))
    args = [F.col("api"), F.col("has_tools"), F.col("has_typed_parts")]
    return rows.select(
        "request_id", "policy",
        policy.policy(*args, compress_with_tools=False).alias("policy_without_tools"),
        policy.policy(*args, passthrough=True).alias("policy_passthrough"),
    )


@CATALOG.add(
    f"""WITH {REQ} SELECT request_id, 'compressible' AS endpoint_class,
    CASE WHEN api = 'messages' THEN 'anthropic' WHEN c % 2 = 1 THEN 'subscription' ELSE 'openai' END AS route,
    CASE WHEN api = 'messages' THEN '/v1/messages' WHEN c % 2 = 1 THEN '' ELSE '/v1' END ||
    CASE api WHEN 'messages' THEN '' WHEN 'chat' THEN '/chat/completions' ELSE '/responses' END || '?beta=' || c AS path
    FROM req"""
)
def route_label(spark, sf):
    e, h = F.col("endpoint"), F.col("headers")
    query = F.concat(F.lit("beta="), F.split_part("request_id", F.lit("-"), F.lit(1)))
    return ad.request_bodies(spark, sf).select(
        "request_id",
        policy.endpoint_class(e).alias("endpoint_class"),
        policy.route_label(e, h).alias("route"),
        policy.upstream_path(e, h, query).alias("path"),
    )


@CATALOG.add(
    """SELECT page_id, CASE WHEN path IN ('/v1/chat/completions', '/v1/messages', '/v1/responses')
      THEN 'compressible' ELSE 'pass_through' END AS endpoint_class
    FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/v1/messages/count_tokens'
          WHEN 2 THEN '/v1/models' WHEN 3 THEN '/v1/responses' ELSE regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) END AS path FROM pages)"""
)
def endpoint_class(spark, sf):
    n = F.col("page_id") % 5
    path = (
        F.when(n == 0, "/v1/messages").when(n == 1, "/v1/messages/count_tokens")
        .when(n == 2, "/v1/models").when(n == 3, "/v1/responses")
        .otherwise(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1))
    )
    return ad.table(spark, sf, "pages").select(
        "page_id", policy.endpoint_class(path).alias("endpoint_class")
    )


@CATALOG.add(
    f"""WITH {REQ} SELECT request_id, 'Content-Type,anthropic-beta,authorization,chatgpt-account-id' AS names,
    '[redacted]' AS secret, 'b' || t AS beta, 'Content-Type,anthropic-beta,anthropic-version' AS anthropic_names,
    '2023-06-01' AS version FROM req"""
)
def header_projection(spark, sf):
    sent = policy.forwarded_headers(F.col("headers"))
    own = policy.anthropic_headers(F.col("headers"))
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return ad.request_bodies(spark, sf).select(
        "request_id", names(sent).alias("names"),
        F.try_element_at(sent, F.lit("authorization")).alias("secret"),
        F.try_element_at(sent, F.lit("anthropic-beta")).alias("beta"),
        names(own).alias("anthropic_names"),
        F.try_element_at(own, F.lit("anthropic-version")).alias("version"),
    )


# --- cache plans --------------------------------------------------------------------------

PLAN = f"""
plan AS (
  SELECT *, CASE WHEN sys = 4 THEN 1 ELSE 0 END AS existing,
         CAST(tools AS INT) + CAST(sys IN (2, 3) AS INT) + 1 AS breakpoints,
         substr(sha256('user' || chr(31) || text || chr(31) || 'assistant' || chr(31) ||
           CASE WHEN tools THEN 'text' || chr(31) || 'Reading' || chr(31) || 'tool_use' || chr(31) ELSE 'Working on it' END), 1, 16) AS session_id,
         (length(text) + CASE WHEN tools THEN 7 + length(py) ELSE 18 + length(coded) END) // 4 AS cached
  FROM req WHERE api = 'messages')"""


def _plans(spark, sf):
    return cache_plan.plan_requests(_requests(spark, sf).where("api = 'messages'"))


@CATALOG.add(
    f"""WITH {REQ}, {PLAN} SELECT request_id, CAST(existing AS INT) AS existing, CAST(breakpoints AS INT) AS breakpoints,
    CAST(3 AS INT) AS prefix_end_index, session_id, CAST(cached AS BIGINT) AS cached_tokens_estimate,
    CAST(existing + breakpoints AS INT) AS n_markers,
    CASE WHEN sys = 4 THEN CASE WHEN tools THEN '0:1h,1:1h,2:5m' ELSE '1:1h,2:5m' END
         ELSE concat_ws(',', CASE WHEN tools THEN '0:5m' END, CASE WHEN sys IN (2, 3) THEN '1:5m' END, '2:5m') END AS lifetimes
    FROM plan"""
)
def breakpoint_plan(spark, sf):
    shown = F.transform(
        "markers", lambda m: F.concat_ws(":", m.section, F.coalesce(m.ttl, F.lit("5m")))
    )
    return _plans(spark, sf).select(
        "request_id", "existing", "breakpoints", "prefix_end_index", "session_id",
        "cached_tokens_estimate", F.size("markers").alias("n_markers"),
        F.array_join(shown, ",").alias("lifetimes"),
    )


@CATALOG.add(
    f"""WITH {REQ}, {PLAN} SELECT request_id, CASE WHEN tools THEN 'tool_use' ELSE 'text' END AS prefix_type,
    CASE WHEN tools THEN CASE WHEN sys = 4 THEN '1h' ELSE '5m' END END AS tool_ttl,
    CASE sys WHEN 0 THEN 'missing' WHEN 1 THEN 'string' ELSE 'list' END AS system_kind,
    CASE sys WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 4 THEN '1h' ELSE '5m' END AS system_ttl FROM plan"""
)
def marked_bodies(spark, sf):
    def lifetime(block):
        cache = V.field(block, "cache_control")
        return F.when(
            cache.isNotNull(), F.coalesce(F.try_variant_get(cache, "$.ttl", "string"), F.lit("5m"))
        )

    body = cache_plan.marked_bodies(_plans(spark, sf)).select("request_id", "body")
    part = lambda name: V.field(F.col("body"), name)
    last = lambda a: F.get(a, F.size(a) - 1)
    target = last(V.as_list(V.field(F.get(V.as_list(part("messages")), F.lit(3)), "content")))
    return body.select(
        "request_id",
        F.when(lifetime(target).isNotNull(), F.try_variant_get(target, "$.type", "string")).alias("prefix_type"),
        lifetime(last(V.as_list(part("tools")))).alias("tool_ttl"),
        V.kind(part("system")).alias("system_kind"),
        lifetime(last(V.as_list(part("system")))).alias("system_ttl"),
    )


RUNS = f"""
timed AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS idle FROM plan WINDOW w AS (PARTITION BY session_id ORDER BY ts, request_id)),
runs AS (SELECT *, sum(CASE WHEN idle IS NULL OR idle > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, request_id) AS run FROM timed)"""


@CATALOG.add(
    f"""WITH {REQ}, {PLAN}, {RUNS} SELECT CAST(count(*) AS BIGINT) AS requests_with_breakpoints,
    CAST(sum(breakpoints) AS BIGINT) AS breakpoints_injected, CAST(sum(cached) AS BIGINT) AS estimated_tokens_cached,
    CAST(count(DISTINCT session_id || ':' || run) AS BIGINT) AS sessions_seen FROM runs"""
)
def cache_stats(spark, sf):
    return sessions.cache_stats(_plans(spark, sf))


@CATALOG.add(
    f"""WITH {REQ}, {PLAN}, {RUNS} SELECT request_id, session_id,
    CASE WHEN session_id IS NOT NULL THEN CAST(run AS BIGINT) END AS run,
    CASE WHEN session_id IS NULL THEN 0
         ELSE CAST(row_number() OVER (PARTITION BY session_id, run ORDER BY ts, request_id) AS BIGINT) END AS turn_count FROM runs"""
)
def request_turns(spark, sf):
    plans = _plans(spark, sf).select("request_id", "session_id", "ts")
    return sessions.turn_counts(plans, "session_id", "ts", "request_id").drop("ts")


# --- compaction ------------------------------------------------------------------------------

PY_S = ad.fill_sql(ad.PY_SKELETON, **FILL)
JS = ad.fill_sql(ad.JS_CODE, **FILL)
JS_S = ad.fill_sql(ad.JS_SKELETON, **FILL)
# A coded text names src/f{k}.py and web/g{k}.js; some system prompts name g7.js or f0.py.
EDIT = f"""
edit AS (
  SELECT *, {POLICY} AS policy,
    NOT (turn = conv_id % 3 OR (api = 'messages' AND sys = 3 AND turn = 0)) AS py_bg,
    NOT (turn = conv_id % 3 OR (api = 'messages' AND sys = 2 AND turn = 7)) AS js_bg,
    {PY_S} AS py_s, {JS} AS js, {JS_S} AS js_s
  FROM req WHERE NOT corrupt),
done AS (
  SELECT *, CASE WHEN policy = 'none' THEN coded ELSE
    replace(replace(coded, CASE WHEN py_bg THEN py ELSE chr(1) END, py_s || chr(10)), CASE WHEN js_bg THEN js ELSE chr(1) END, js_s || chr(10)) END AS small,
    '[stale result of `lib/f' || (conv_id % 3) || '.py` replaced by its skeleton: a newer read follows]' || chr(10) || py_s AS note
  FROM edit)"""
TOK = lambda x: f"(length({x}) // 4)"
METRICS = f"""
metrics AS (
  SELECT request_id, ts, model, policy,
    CASE WHEN hollow THEN 3 WHEN plain_input THEN 7 + {TOK('coded')}
         WHEN api = 'responses' THEN 11 + {TOK('coded')} + CASE WHEN odd = 3 THEN 0 ELSE {TOK('text')} END
         WHEN tools THEN 27 + {TOK('text')} + 1 + {TOK('coded')}
         ELSE 27 + {TOK('text')} + 3 + 1 + 0 + 2 * {TOK('coded')} END AS original_tokens,
    CASE WHEN hollow THEN 3 WHEN plain_input THEN 7 + {TOK('small')}
         WHEN api = 'responses' THEN 11 + {TOK('small')} + CASE WHEN odd = 3 THEN 0 ELSE {TOK('text')} END
         WHEN tools THEN 27 + {TOK('text')} + 1 + {TOK('small')}
         ELSE 27 + {TOK('text')} + 3 + 1 + 0 + {TOK('small')} + CASE WHEN api = 'messages' THEN {TOK('coded')} ELSE {TOK('small')} END END AS compressed_tokens,
    CASE WHEN api = 'chat' AND tools THEN {TOK('py')} - {TOK('note')} ELSE 0 END AS tool_result_tokens_saved
  FROM done)"""
METRIC_COLUMNS = """request_id, ts AT TIME ZONE 'UTC' AS ts, model, policy, CAST(original_tokens AS BIGINT) AS original_tokens,
    CAST(compressed_tokens AS BIGINT) AS compressed_tokens, CAST(tool_result_tokens_saved AS BIGINT) AS tool_result_tokens_saved"""


@CATALOG.add(f"WITH {REQ}, {EDIT}, {METRICS} SELECT {METRIC_COLUMNS.replace('ts AT TIME ZONE', 'ts AT TIME ZONE')} FROM metrics")
def request_metrics(spark, sf):
    rows = compact(_parsed(spark, sf)).request_metrics()
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@CATALOG.add(
    f"""WITH {REQ}, {EDIT}, {METRICS}, again AS (SELECT * FROM metrics UNION ALL SELECT * FROM metrics WHERE CAST(split_part(request_id, '-', 1) AS BIGINT) % 3 = 0)
    SELECT {METRIC_COLUMNS.replace('ts AT TIME ZONE', 'ts AT TIME ZONE')} FROM again"""
)
def retried_metrics(spark, sf):
    """A log in which retries keep their request's id, and token counts are asked for in between."""
    first = ad.request_bodies(spark, sf)
    retried = first.where(F.split_part("request_id", F.lit("-"), F.lit(1)).cast("bigint") % 3 == 0)
    counted = first.where("endpoint = '/v1/messages'").withColumn(
        "endpoint", F.lit("/v1/messages/count_tokens")
    )
    log = first.unionByName(retried).unionByName(counted)
    rows = compact(parse_bodies(log)).request_metrics()
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@CATALOG.add(
    f"""WITH {PRICES}, {REQ}, {EDIT}, {METRICS} SELECT metrics.model, policy, CAST(count(*) AS BIGINT) AS requests,
    CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens,
    CAST(sum(original_tokens - compressed_tokens) AS BIGINT) AS tokens_saved,
    round(sum((original_tokens / 1e6 - compressed_tokens / 1e6) * coalesce(p_in, 3.0)), 8) AS cost_saved
    FROM metrics LEFT JOIN prices ON prices.model = metrics.model GROUP BY 1, 2"""
)
def savings_report(spark, sf):
    metrics = compact(_parsed(spark, sf)).request_metrics()
    costs = accounting.request_costs(metrics, default_pricing(spark))
    return accounting.totals(costs.drop("ts"), "model", "policy").select(
        "model", "policy", "requests", "original_tokens", "compressed_tokens", "tokens_saved",
        F.round("cost_saved", 8).alias("cost_saved"),
    )


@CATALOG.add(
    f"""WITH {REQ}, {EDIT}, u AS (
      SELECT request_id, 5 AS msg_idx, small AS new_text FROM done WHERE api <> 'responses'
      UNION ALL SELECT request_id, 3, CASE WHEN api = 'messages' THEN coded ELSE small END FROM done WHERE api <> 'responses' AND NOT tools)
    SELECT request_id, CAST(msg_idx AS INT) AS msg_idx, new_text FROM u"""
)
def prefix_guard(spark, sf):
    units = compact(_parsed(spark, sf)).units
    return units.where("policy <> 'none' AND text LIKE '%```%' AND NOT is_skipped AND prefix_end_index IS NOT NULL").join(
        _requests(spark, sf).where("api <> 'responses'").select("request_id"), "request_id", "left_semi"
    ).select("request_id", "msg_idx", "new_text")


@CATALOG.add(
    f"""WITH {REQ}, {EDIT} SELECT request_id, CAST(2 AS INT) AS msg_idx, 'lib/f' || (conv_id % 3) || '.py' AS note_file,
    CASE WHEN api = 'messages' THEN py ELSE note END AS new_text, true AS was_compressed
    FROM done WHERE tools AND api <> 'responses'"""
)
def compress_tool_aware(spark, sf):
    return compact(_parsed(spark, sf)).results.select(
        "request_id", "msg_idx", "note_file", "new_text", "was_compressed"
    )


@CATALOG.add(
    f"""WITH {REQ}, {EDIT} SELECT request_id,
    CAST(CASE WHEN api <> 'responses' THEN CASE WHEN tools THEN 3 ELSE 4 END ELSE 2 END AS BIGINT) AS total_blocks,
    CAST(CASE WHEN api = 'responses' OR tools THEN 1 ELSE 2 END * (CAST(py_bg AS INT) + CAST(js_bg AS INT))
      + CASE WHEN api <> 'responses' AND tools THEN 1 ELSE 0 END AS BIGINT) AS skeletonized_blocks
    FROM done WHERE NOT hollow AND policy <> 'none'"""
)
def request_block_counts(spark, sf):
    return compact(_parsed(spark, sf)).block_counts()


REWRITTEN = f"""WITH {REQ}, {EDIT} SELECT request_id, small AS last_text,
    CASE WHEN tools THEN CASE WHEN api = 'messages' THEN py ELSE note END END AS first_result,
    CAST(6 AS INT) AS n_items FROM done WHERE api <> 'responses'"""


@CATALOG.add(REWRITTEN)
def rewritten_bodies(spark, sf):
    return _shown(compact(_parsed(spark, sf)).rewritten_bodies())


@CATALOG.add(REWRITTEN)
def bodies_roundtrip(spark, sf):
    """Rewritten bodies as JSON lines, read back as a log."""
    where = f"{ensure_checkpoint_dir(spark)}/bodies-{uuid.uuid4().hex}"
    write_bodies(compact(_parsed(spark, sf)).rewritten_bodies(), where)
    return _shown(parse_bodies(read_log(spark, where)))


def _shown(out):
    items = V.as_list(V.field(F.col("body"), "messages"))
    return out.where(V.field(F.col("body"), "messages").isNotNull()).select(
        "request_id",
        F.try_variant_get(F.get(items, F.lit(5)), "$.content", "string").alias("last_text"),
        F.try_variant_get(F.get(items, F.lit(2)), "$.content[0].content", "string").alias("first_result"),
        F.size(items).alias("n_items"),
    )


@CATALOG.add(
    f"""WITH {REQ}, {EDIT} SELECT request_id, CASE WHEN plain_input THEN small ELSE small END AS first_text,
    CASE WHEN plain_input THEN 'string' ELSE 'function_call,function_call_output' END AS kept
    FROM done WHERE api = 'responses' AND NOT hollow"""
)
def responses_rewrite(spark, sf):
    out = compact(_parsed(spark, sf)).rewritten_bodies()
    given = V.field(F.col("body"), "input")
    items = V.as_list(given)
    types = F.transform(F.slice(items, 2, 2), lambda i: F.try_variant_get(i, "$.type", "string"))
    return out.where(given.isNotNull()).select(
        "request_id",
        F.coalesce(V.as_text(given), F.try_variant_get(F.get(items, F.lit(0)), "$.content", "string")).alias("first_text"),
        F.coalesce(F.array_join(types, ","), V.kind(given)).alias("kept"),
    )


@CATALOG.add(f"WITH {REQ} SELECT CAST(count(*) AS BIGINT) AS requests FROM req WHERE NOT corrupt")
def passthrough_unchanged(spark, sf):
    """With passthrough every body leaves as it came."""
    parsed = _parsed(spark, sf).where(~F.col("corrupt"))
    out = compact(parsed, Options(passthrough=True)).rewritten_bodies()
    # Spark counts a body as 20 bytes and would broadcast all of them; both sides are as large as the log.
    same = parsed.select("request_id", F.col("body").cast("string").alias("before")).join(
        out.select("request_id", F.col("body").cast("string").alias("after")).hint("merge"), "request_id"
    )
    return same.where("before = after").agg(F.count("*").alias("requests"))
