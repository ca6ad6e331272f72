"""Message-table queries: tokens, cost, cache planning, file references, code blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ctxlens import adapters as ad
from ctxlens import fixed_values as fv
from ctxlens.catalog import Catalog
from ctxlens.functions import formats, text
from ctxlens.functions.tokens import heuristic_tokens
from ctxlens.operators import accounting, active_files, cache_plan, messages, reuse
from ctxlens.operators.skeletons import HEADER, line_stats, skeletons
from ctxlens.plans.compaction import Options, compress_plain
from ctxlens.runtime import ensure_checkpoint_dir
from ctxlens.sources.pricing import default_pricing

CATALOG = Catalog()

CODED = ad.fill_sql(ad.CODED, **ad.HOLES_SQL)
PRICES = "prices(model, p_in, p_out) AS (VALUES " + ", ".join(
    f"('{m}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, i, o in fv.PRICING_ROWS
) + ")"
TOKENS = "CAST(length(text) // 4 AS BIGINT)"


# --- tokens and cost ----------------------------------------------------------------


@CATALOG.add(f"SELECT conv_id, turn, {TOKENS} AS tokens FROM conversations")
def message_tokens(spark, sf):
    return ad.table(spark, sf, "conversations").select(
        "conv_id", "turn", heuristic_tokens(F.col("text")).alias("tokens")
    )


REQUEST_TOKENS = f"""
req AS (SELECT conv_id AS request_id, {ad.MODEL_SQL} AS model,
               CAST(sum(4 + {TOKENS}) + 3 AS BIGINT) AS tokens
        FROM conversations GROUP BY 1, 2)"""


@CATALOG.add(f"WITH {REQUEST_TOKENS} SELECT request_id, tokens FROM req")
def request_tokens(spark, sf):
    msgs = ad.chat_messages(spark, sf)
    return accounting.request_tokens(msgs, heuristic_tokens(F.col("text")))


def _costs(spark, sf):
    """Each conversation as a request; the compacted form keeps user messages only."""
    tokens = fv.TOKENS_PER_MESSAGE + heuristic_tokens(F.col("text"))
    metrics = (
        ad.chat_messages(spark, sf)
        .groupBy("request_id", "model")
        .agg(
            (F.sum(tokens) + fv.TOKENS_PER_REPLY).cast("bigint").alias("original_tokens"),
            (F.sum(F.when(F.col("role") == "user", tokens).otherwise(0)) + fv.TOKENS_PER_REPLY)
            .cast("bigint").alias("compressed_tokens"),
        )
    )
    return accounting.request_costs(metrics, default_pricing(spark))


COSTS = f"""
WITH {PRICES},
req AS (SELECT conv_id AS request_id, {ad.MODEL_SQL} AS model,
               CAST(sum(4 + {TOKENS}) + 3 AS BIGINT) AS original_tokens,
               CAST(sum(CASE WHEN role = 'user' THEN 4 + {TOKENS} ELSE 0 END) + 3 AS BIGINT) AS compressed_tokens
        FROM conversations GROUP BY 1, 2),
costs AS (
  SELECT request_id, req.model, original_tokens, compressed_tokens,
         original_tokens - compressed_tokens AS tokens_saved,
         CASE WHEN original_tokens = 0 THEN 0.0 ELSE 1.0 - CAST(compressed_tokens AS DOUBLE) / original_tokens END AS compression_ratio,
         original_tokens / 1e6 * coalesce(p.p_in, 3.0) AS original_cost,
         compressed_tokens / 1e6 * coalesce(p.p_in, 3.0) AS compressed_cost
  FROM req LEFT JOIN prices p ON p.model = req.model)
"""


@CATALOG.add(
    COSTS
    + """SELECT request_id, model, original_tokens, compressed_tokens, tokens_saved,
    round(compression_ratio, 6) AS compression_ratio, round(original_cost, 8) AS original_cost,
    round(compressed_cost, 8) AS compressed_cost,
    round(original_cost - compressed_cost, 8) AS cost_saved FROM costs"""
)
def request_cost(spark, sf):
    df = _costs(spark, sf)
    rounded = ["compression_ratio", "original_cost", "compressed_cost", "cost_saved"]
    return df.select(
        *[c for c in df.columns if c not in rounded],
        *[F.round(c, 6 if c == "compression_ratio" else 8).alias(c) for c in rounded],
    )


@CATALOG.add(
    COSTS
    + """SELECT model, CAST(count(*) AS BIGINT) AS requests,
    CAST(sum(original_tokens) AS BIGINT) AS original_tokens,
    CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens,
    round(sum(original_cost - compressed_cost), 8) AS cost_saved,
    CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved,
    round(1.0 - CAST(sum(compressed_tokens) AS DOUBLE) / sum(original_tokens), 6) AS compression_ratio
    FROM costs GROUP BY model"""
)
def cost_by_model(spark, sf):
    return accounting.totals(_costs(spark, sf), "model").withColumns(
        {"cost_saved": F.round("cost_saved", 8), "compression_ratio": F.round("compression_ratio", 6)}
    )


@CATALOG.add(
    COSTS
    + """, levels AS (
      SELECT model, request_id % 3 AS part, sum(original_tokens) AS o, sum(compressed_tokens) AS c,
             grouping(model) * 2 + grouping(request_id % 3) AS level
      FROM costs GROUP BY ROLLUP (model, request_id % 3))
    SELECT model, CAST(part AS VARCHAR) AS part, CAST(o AS BIGINT) AS original_tokens, CAST(c AS BIGINT) AS compressed_tokens,
    CAST(level AS BIGINT) AS level, CAST(o - c AS BIGINT) AS tokens_saved,
    round(1.0 - CAST(c AS DOUBLE) / o, 6) AS compression_ratio FROM levels"""
)
def savings_rollup(spark, sf):
    df = _costs(spark, sf).withColumn("part", F.col("request_id") % 3)
    return accounting.savings_rollup(df, "model", "part").withColumns(
        {"part": F.col("part").cast("string"), "compression_ratio": F.round("compression_ratio", 6)}
    )


@CATALOG.add(
    COSTS
    + """SELECT CAST(count(*) AS BIGINT) AS requests_processed,
    CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved FROM costs"""
)
def health_totals(spark, sf):
    return accounting.health(_costs(spark, sf))


@CATALOG.add(
    COSTS
    + """SELECT request_id,
    CASE WHEN original_tokens >= 1000000 THEN printf('%.1fM', original_tokens / 1e6)
         WHEN original_tokens >= 1000 THEN printf('%.1fk', original_tokens / 1e3)
         ELSE CAST(original_tokens AS VARCHAR) END AS tokens,
    printf('$%.2f', original_cost * 1001) AS cost,
    printf('%02d:%02d:%02d', request_id // 3600, request_id % 3600 // 60, request_id % 60) AS uptime,
    repeat('█', CAST(floor(compression_ratio * 20) AS INT))
      || repeat('░', 20 - CAST(floor(compression_ratio * 20) AS INT)) AS bar
    FROM costs"""
)
def report_formats(spark, sf):
    df = _costs(spark, sf)
    bar = formats.bar_text(F.col("compression_ratio"))
    return df.select(
        "request_id",
        formats.tokens_text(F.col("original_tokens")).alias("tokens"),
        formats.money_text(F.col("original_cost") * 1001).alias("cost"),
        formats.duration_text(F.col("request_id")).alias("uptime"),
        F.split_part(bar, F.lit(" "), F.lit(1)).alias("bar"),
    )


# --- prompt cache -------------------------------------------------------------------


@CATALOG.add(
    """WITH m AS (SELECT conv_id, turn, length(text) AS n_chars,
                  count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id AS request_id, CAST(max(n) AS BIGINT) AS n_messages,
    CAST(CASE WHEN max(n) >= 3 AND max(n_chars) FILTER (turn = n - 3) > 0 THEN max(n) - 3 ELSE -1 END AS BIGINT) AS prefix_end_index,
    CAST(CASE WHEN max(n) >= 3 THEN coalesce(sum(n_chars) FILTER (turn < n - 2), 0) // 4 ELSE 0 END AS BIGINT)
      AS cached_tokens_estimate
    FROM m GROUP BY conv_id"""
)
def cached_prefix(spark, sf):
    msgs = ad.chat_messages(spark, sf).withColumn("n_chars", F.length("text").cast("bigint"))
    return cache_plan.prefix_estimate(msgs)


# Every user turn is a request with all messages so far; later requests of some conversations edit an early one.
GROWING = """
asked AS (SELECT conv_id, turn AS upto, conv_id * 1000 + turn AS request_id FROM conversations WHERE role = 'user'),
sent AS (SELECT request_id, a.conv_id, upto, c.turn, c.role,
         c.text || CASE WHEN a.conv_id % 4 = 0 AND upto >= 4 AND c.turn = 2 THEN ' (edited)' ELSE '' END AS text
  FROM asked a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn <= upto),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY upto) AS no,
             lag(request_id) OVER (PARTITION BY conv_id ORDER BY upto) AS previous_id FROM asked),
sizes AS (SELECT request_id, count(*) AS n, max(length(text)) FILTER (turn = upto - 2) AS cut_off FROM sent GROUP BY 1),
covered AS (SELECT request_id, CASE WHEN n >= 3 AND cut_off > 0 THEN n - 2 ELSE 0 END AS covered FROM sizes),
shared AS (SELECT q.request_id, q.previous_id, coalesce(min(s.turn) FILTER (p.turn IS NULL OR p.text <> s.text OR p.role <> s.role), max(s.turn) + 1) AS common
  FROM numbered q JOIN sent s USING (request_id) LEFT JOIN sent p ON p.request_id = q.previous_id AND p.turn = s.turn GROUP BY 1, 2),
reused AS (SELECT q.*, n, coalesce(common, 0) AS common, least(coalesce(common, 0), coalesce(covered, 0)) AS reused
  FROM numbered q JOIN sizes USING (request_id) LEFT JOIN shared USING (request_id)
  LEFT JOIN covered ON covered.request_id = q.previous_id)"""


@CATALOG.add(
    f"""WITH {GROWING} SELECT r.request_id, conv_id AS session_id, CAST(no AS BIGINT) AS turn, r.previous_id, CAST(n AS BIGINT) AS n_messages,
    CAST(r.common AS BIGINT) AS common_messages, CAST(reused AS BIGINT) AS reused_messages,
    CAST((SELECT coalesce(sum(length(text)), 0) FROM sent s WHERE s.request_id = r.request_id AND s.turn < reused) // 4 AS BIGINT) AS reused_tokens
    FROM reused r"""
)
def prefix_reuse(spark, sf):
    given = ad.table(spark, sf, "conversations")
    asked = given.where("role = 'user'").select(
        "conv_id", F.col("turn").alias("at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id")
    )
    edited = (F.col("conv_id") % 4 == 0) & (F.col("at") >= 4) & (F.col("turn") == 2)
    sent = asked.join(given, "conv_id").where(F.col("turn") <= F.col("at"))
    msgs = sent.select(
        "request_id", F.col("turn").cast("int").alias("msg_idx"), "role",
        F.concat("text", F.when(edited, " (edited)").otherwise("")).alias("text"),
    )
    order = asked.select("request_id", F.col("conv_id").alias("session_id"), F.timestamp_seconds("at").alias("ts"))
    return reuse.prefix_reuse(msgs, order)


@CATALOG.add(
    """SELECT conv_id AS request_id,
    substr(sha256(string_agg(role || chr(31) || text, chr(31) ORDER BY turn)), 1, 16) AS session_id
    FROM conversations WHERE turn < 2 GROUP BY conv_id"""
)
def session_fingerprint(spark, sf):
    return cache_plan.flat_fingerprint(ad.chat_messages(spark, sf))


MARKERS = """
m AS (SELECT conv_id AS request_id, CAST(turn % 3 AS INT) AS section, CAST(turn AS INT) AS idx,
             0 AS sub_idx, CASE WHEN turn % 5 = 3 THEN '1h' END AS ttl FROM conversations)"""


@CATALOG.add(
    f"""WITH {MARKERS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY section, idx, sub_idx) AS n FROM m)
    SELECT request_id, section, idx, sub_idx, ttl, CAST(n AS INT) AS marker_no FROM r WHERE n <= 4"""
)
def marker_budget(spark, sf):
    return cache_plan.within_budget(ad.message_markers(spark, sf))


@CATALOG.add(
    f"""WITH {MARKERS}, l AS (SELECT request_id, max(section * 1000000 + idx) AS last FROM m WHERE ttl = '1h' GROUP BY 1)
    SELECT request_id, section, idx, sub_idx,
    CASE WHEN section * 1000000 + idx <= last THEN '1h' ELSE ttl END AS ttl
    FROM m LEFT JOIN l USING (request_id)"""
)
def ttl_promotion(spark, sf):
    return cache_plan.promoted(ad.message_markers(spark, sf))


@CATALOG.add(f"WITH {MARKERS} SELECT request_id, CAST(count(*) AS BIGINT) AS n_markers FROM m GROUP BY 1")
def marker_counts(spark, sf):
    return cache_plan.marker_counts(ad.message_markers(spark, sf))


# --- file references and code blocks ---------------------------------------------------

EXTS = "|".join(e.lstrip(".") for e in fv.CODE_EXTENSIONS)
BLOCK_RE = (
    r"(?s)(?:(?:#|//)\s*(?:File|file|MODULE|module):\s*(\S+)\n|"
    r"(?:/\*\s*(?:File|file|MODULE|module):\s*(\S+)\s*\*/\n|<!--\s*file:\s*(\S+)\s*-->\n))?"
    r"```(\w*)\n(.*?)```"
)
PATH_RE = r"(?m)(?:^|[\s`" + r"\"''\(])([.\w/\\-]+\.(?:" + EXTS + r"))(?:[\s`" + r"\"''\),:;]|$)"
HEAD_RE = r"(?i)#+\s*(?:File|Module|Script):\s*(\S+)"
CODED_ROWS = f"coded AS (SELECT conv_id, turn, role, {ad.MODEL_SQL} AS model, {CODED} AS text FROM conversations)"
REFS = f"""
refs AS (
  SELECT conv_id, turn, role, unnest(regexp_extract_all(regexp_replace(text, '{BLOCK_RE}', '', 'g'), '{PATH_RE}', 1)) AS name, 'path' AS kind FROM coded
  UNION ALL
  SELECT conv_id, turn, role, unnest(regexp_extract_all(regexp_replace(text, '{BLOCK_RE}', '', 'g'), '{HEAD_RE}', 1)) AS name, 'heading' AS kind FROM coded)"""
KEY = "lower(list_extract(string_split(rtrim(replace(name, '\\', '/'), '/'), '/'), -1))"


@CATALOG.add(f"WITH {CODED_ROWS}, {REFS} SELECT conv_id AS request_id, CAST(turn AS INT) AS msg_idx, name FROM refs WHERE kind = 'path'")
def file_refs(spark, sf):
    prose = text.without_code_blocks(F.col("text"))
    return ad.chat_messages(spark, sf, coded=True).select(
        "request_id", "msg_idx", F.explode(text.path_references(prose)).alias("name")
    )


@CATALOG.add(f"WITH {CODED_ROWS}, {REFS} SELECT conv_id AS request_id, CAST(turn AS INT) AS msg_idx, name FROM refs WHERE kind = 'heading'")
def heading_refs(spark, sf):
    prose = text.without_code_blocks(F.col("text"))
    return ad.chat_messages(spark, sf, coded=True).select(
        "request_id", "msg_idx", F.explode(text.heading_references(prose)).alias("name")
    )


ACTIVE = f"act AS (SELECT DISTINCT conv_id, {KEY} AS file_key FROM refs WHERE role IN ('user', 'system'))"


@CATALOG.add(f"WITH {CODED_ROWS}, {REFS}, {ACTIVE} SELECT conv_id AS request_id, file_key FROM act", name="active_files")
def _active_files(spark, sf):
    return active_files.active_files(ad.chat_messages(spark, sf, coded=True))


@CATALOG.add(
    "SELECT conv_id AS request_id, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1"
)
def last_user_text(spark, sf):
    return messages.last_user_text(ad.chat_messages(spark, sf))


LANG = "CASE regexp_extract(filename, '\\.[^.]*$') " + " ".join(
    f"WHEN '{e}' THEN '{lang}'" for e, lang in fv.EXTENSION_LANGUAGE.items()
) + " ELSE '' END"
BLOCKS = f"""
raw AS (
  SELECT conv_id, turn, text, i - 1 AS block_idx,
         regexp_extract_all(text, '{BLOCK_RE}', 1)[i] AS g1, regexp_extract_all(text, '{BLOCK_RE}', 2)[i] AS g2,
         regexp_extract_all(text, '{BLOCK_RE}', 3)[i] AS g3, regexp_extract_all(text, '{BLOCK_RE}', 4)[i] AS fence,
         regexp_extract_all(text, '{BLOCK_RE}', 5)[i] AS code
  FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, '{BLOCK_RE}')) + 1)) AS i FROM coded)),
named AS (SELECT conv_id, turn, block_idx, coalesce(fence, '') AS fence, code,
                 coalesce(nullif(g1, ''), nullif(g2, ''), nullif(g3, '')) AS filename FROM raw),
blocks AS (
  SELECT conv_id AS request_id, CAST(turn AS INT) AS msg_idx, CAST(block_idx AS INT) AS block_idx, filename,
         {KEY.replace('name', 'filename')} AS file_key, code,
         CASE WHEN fence = '' AND filename IS NOT NULL THEN {LANG} ELSE fence END AS language
  FROM named)"""


def _units(spark, sf):
    return ad.chat_messages(spark, sf, coded=True).withColumn("part_idx", F.lit(-1))


@CATALOG.add(f"WITH {CODED_ROWS}, {BLOCKS} SELECT * FROM blocks")
def code_blocks(spark, sf):
    return active_files.blocks(_units(spark, sf)).drop("part_idx")


@CATALOG.add(
    f"""WITH {CODED_ROWS}, {REFS}, {ACTIVE}, {BLOCKS}
    SELECT request_id, msg_idx, block_idx, filename,
    filename IS NULL OR EXISTS (SELECT 1 FROM act WHERE act.conv_id = request_id AND act.file_key = blocks.file_key) AS is_active
    FROM blocks"""
)
def block_active(spark, sf):
    msgs = ad.chat_messages(spark, sf, coded=True)
    marked = active_files.with_activity(
        active_files.blocks(_units(spark, sf)), active_files.active_files(msgs)
    )
    return marked.select("request_id", "msg_idx", "block_idx", "filename", "is_active")


# --- skeletons -----------------------------------------------------------------------

FILL = {**ad.HOLES_SQL, "header": f"'{HEADER}'"}


def _skeleton_sql(code: str, skeleton: str, language: str, before: int, after: int) -> str:
    return f"""
    SELECT DISTINCT '{language}' AS language, sha256({ad.fill_sql(code, **FILL)}) AS code_hash,
    sha256({ad.fill_sql(skeleton, **FILL)}) AS skeleton_hash,
    CAST({before} AS INT) AS original_lines, CAST({after} AS INT) AS skeleton_lines,
    CAST({before - after} AS INT) AS lines_saved,
    round(1.0 - {after} / CAST({before} AS DOUBLE), 6) AS ratio, true AS was_compressed FROM conversations"""


def _skeleton_rows(spark, sf, code: str, language: str, **options):
    codes = ad.table(spark, sf, "conversations").select(
        F.lit(language).alias("language"), ad.fill(code, **ad.holes()).alias("code")
    )
    done = skeletons(codes, **options)
    hashes = done.select("code_hash", F.sha2("skeleton", 256).alias("skeleton_hash"), "language",
                         "original_lines", "skeleton_lines", "was_compressed")
    return line_stats(hashes.withColumn("skeleton", F.col("skeleton_hash"))).join(
        hashes.select("code_hash", "skeleton_hash"), "code_hash"
    ).withColumn("ratio", F.round("ratio", 6))


@CATALOG.add(_skeleton_sql(ad.PY_CODE, ad.PY_SKELETON, "python", 4, 3))
def skeleton_python(spark, sf):
    return _skeleton_rows(spark, sf, ad.PY_CODE, "python")


@CATALOG.add(_skeleton_sql(ad.JS_CODE, ad.JS_SKELETON, "javascript", 4, 2))
def skeleton_cstyle(spark, sf):
    return _skeleton_rows(spark, sf, ad.JS_CODE, "javascript")


@CATALOG.add(_skeleton_sql(ad.GO_CODE, ad.GO_SKELETON, "go", 6, 4))
def skeleton_go(spark, sf):
    return _skeleton_rows(spark, sf, ad.GO_CODE, "go")


@CATALOG.add(_skeleton_sql(ad.RUST_CODE, ad.RUST_SKELETON, "rust", 4, 2))
def skeleton_rust(spark, sf):
    return _skeleton_rows(spark, sf, ad.RUST_CODE, "rust")


@CATALOG.add(_skeleton_sql(ad.CLASS_CODE, ad.CLASS_SKELETON, "python", 8, 7))
def skeleton_classes(spark, sf):
    return _skeleton_rows(spark, sf, ad.CLASS_CODE, "python")


@CATALOG.add(_skeleton_sql(ad.CLASS_CODE, ad.CLASS_DOCS, "python", 8, 8))
def skeleton_class_docs(spark, sf):
    """Docstrings kept, class attributes left out."""
    return _skeleton_rows(
        spark, sf, ad.CLASS_CODE, "python", keep_docstrings=True, keep_class_attrs=False
    )


PY = ad.fill_sql(ad.PY_CODE, **FILL)
PY_S = ad.fill_sql(ad.PY_SKELETON, **FILL)
JS = ad.fill_sql(ad.JS_CODE, **FILL)
JS_S = ad.fill_sql(ad.JS_SKELETON, **FILL)
EDITED = f"""
flags AS (
  SELECT conv_id, turn, role, text, {CODED} AS coded_text, {PY} AS py, {PY_S} AS py_s, {JS} AS js, {JS_S} AS js_s,
         NOT EXISTS (SELECT 1 FROM act WHERE act.conv_id = c.conv_id AND act.file_key = 'f' || c.turn || '.py') AS py_bg,
         NOT EXISTS (SELECT 1 FROM act WHERE act.conv_id = c.conv_id AND act.file_key = 'g' || c.turn || '.js') AS js_bg
  FROM conversations c),
edited AS (
  SELECT *, replace(replace(coded_text, CASE WHEN py_bg THEN py ELSE chr(1) END, py_s || chr(10)),
                    CASE WHEN js_bg THEN js ELSE chr(1) END, js_s || chr(10)) AS new_text FROM flags)"""


@CATALOG.add(
    f"WITH {CODED_ROWS}, {REFS}, {ACTIVE}, {EDITED} SELECT conv_id AS request_id, CAST(turn AS INT) AS msg_idx, new_text FROM edited",
    name="compress_plain",
)
def _compress_plain(spark, sf):
    return _compressed(spark, sf)[0].select("request_id", "msg_idx", "new_text")


def _compressed(spark, sf):
    return compress_plain(ad.chat_messages(spark, sf, coded=True))


@CATALOG.add(
    f"WITH {CODED_ROWS}, {REFS}, {ACTIVE}, {EDITED} SELECT conv_id AS request_id, CAST(turn AS INT) AS msg_idx, new_text FROM edited"
)
def compress_stored(spark, sf):
    """A log that grows: a third of the conversations first, then all, with skeletons kept in between."""
    options = Options(skeleton_store=f"{ensure_checkpoint_dir(spark)}/skeletons-{uuid.uuid4().hex}")
    msgs = ad.chat_messages(spark, sf, coded=True)
    compress_plain(msgs.where(F.col("request_id") % 3 == 0), options=options)
    return compress_plain(msgs, options=options)[0].select("request_id", "msg_idx", "new_text")


@CATALOG.add(
    f"""WITH {CODED_ROWS}, {REFS}, {ACTIVE}, {EDITED}
    SELECT conv_id AS request_id, CAST(2 * count(*) AS BIGINT) AS total_blocks,
    CAST(sum(CAST(py_bg AS INT) + CAST(js_bg AS INT)) AS BIGINT) AS skeletonized_blocks FROM edited GROUP BY conv_id"""
)
def block_counts(spark, sf):
    return active_files.block_counts(_compressed(spark, sf)[1])


@CATALOG.add(
    f"""WITH {CODED_ROWS}, {REFS}, {ACTIVE}, {EDITED},
    per AS (
      SELECT 'lib/f' || turn || '.py' AS filename, py AS code, CASE WHEN py_bg THEN py_s ELSE py END AS after, py_bg AS bg FROM edited
      UNION ALL
      SELECT 'web/g' || turn || '.js', js, CASE WHEN js_bg THEN js_s ELSE js END, js_bg FROM edited)
    SELECT filename, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(length(code) // 4) AS BIGINT) AS original_tokens,
    CAST(sum(length(after) // 4) AS BIGINT) AS compressed_tokens,
    CAST(sum(CAST(bg AS INT)) AS BIGINT) AS skeletonized,
    CAST(sum(length(code) // 4) - sum(length(after) // 4) AS BIGINT) AS tokens_saved,
    round(1.0 - CAST(sum(length(after) // 4) AS DOUBLE) / sum(length(code) // 4), 6) AS compression_ratio
    FROM per GROUP BY filename"""
)
def file_stats(spark, sf):
    return accounting.file_report(_compressed(spark, sf)[1]).withColumn(
        "compression_ratio", F.round("compression_ratio", 6)
    )
