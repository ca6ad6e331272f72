"""Request logs, tool traffic and code derived from the driver's tables.

The tables hold invented prose, with no code and no file names. These adapters
add both by row-wise expressions, so that every derived table grows with its
source table. A text template fills the names `{c}` (conversation), `{t}` (turn),
`{k}` (conversation modulo 3) and `{text}` in Spark and in SQL alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlens.functions.once import once

PY_CODE = "def step_{t}(x):\n    y = x + {c}\n    z = y * 2\n    return z\n"
PY_SKELETON = "{header}\ndef step_{t}(x):\n    ..."
JS_CODE = "function run{t}(a) {\n  const b = a + {c};\n  return b;\n}\n"
JS_SKELETON = "{header}\nfunction run{t}(a) { ... \n"
GO_CODE = "package p\n\nfunc (s *S) Run{t}(a int) int {\n\tb := a + {c}\n\treturn b\n}\n"
GO_SKELETON = "{header}\npackage p\n\nfunc (s *S) Run{t}(a int) int { ... \n"
RUST_CODE = "pub fn go{t}(a: i32) -> i32 {\n    let b = a + {c};\n    b\n}\n"
RUST_SKELETON = "{header}\npub fn go{t}(a: i32) -> i32 { ... \n"
CLASS_CODE = (
    'class S{t}(B):\n    """Doc."""\n    rate: float = {c}.5\n\n    @once\n    def run(self):\n'
    '        """Say."""\n        return {c}\n'
)
CLASS_SKELETON = "{header}\nclass S{t}(B):\n    rate: float = {c}.5\n\n    @once\n    def run(self):\n        ..."
CLASS_DOCS = '{header}\nclass S{t}(B):\n    """Doc."""\n\n    @once\n    def run(self):\n        """Say."""\n        ...'
CODED = (
    "{text}\nFix src/f{k}.py now\n## Module: web/g{k}.js\n"
    "# File: lib/f{t}.py\n```python\n" + PY_CODE + "```\nthen\n"
    "// File: web/g{t}.js\n```\n" + JS_CODE + "```\nend\n"
)

MODELS = ["gpt-4o", "claude-3-opus-20240229", "gpt-4o-mini", "unlisted-model"]

_HOLE = re.compile(r"\{(c|t|k|text|header)\}")


def fill(template: str, **values: Column) -> Column:
    """The template as a column."""
    parts = _HOLE.split(template)
    return F.concat(
        *[
            F.lit(p) if i % 2 == 0 else values[p].cast("string")
            for i, p in enumerate(parts)
            if i % 2 or p
        ]
    )


def fill_sql(template: str, **values: str) -> str:
    """The template as an SQL expression."""
    parts = _HOLE.split(template)
    quoted = [
        "E'" + p.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"
        if i % 2 == 0
        else f"CAST({values[p]} AS VARCHAR)"
        for i, p in enumerate(parts)
        if i % 2 or p
    ]
    return "(" + " || ".join(quoted) + ")"


HOLES_SQL = {"c": "conv_id", "t": "turn", "k": "(conv_id % 3)", "text": "text"}


def holes() -> dict[str, Column]:
    return {
        "c": F.col("conv_id"),
        "t": F.col("turn"),
        "k": F.col("conv_id") % 3,
        "text": F.col("text"),
    }


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_of(number: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MODELS]), (number % len(MODELS)).cast("int"))


MODEL_SQL = (
    "CASE conv_id % 4 "
    + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS))
    + " END"
)


def chat_messages(spark: SparkSession, sf_dir: str, coded: bool = False) -> DataFrame:
    """conversations as messages(request_id, msg_idx, role, model, text, …)."""
    text = fill(CODED, **holes()) if coded else F.col("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").cast("int").alias("msg_idx"),
        "role",
        model_of(F.col("conv_id")).alias("model"),
        text.alias("text"),
        F.lit("string").alias("content_kind"),
        F.lit(False).alias("detect_only"),
    )


def message_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache markers on every turn: section, place and lifetime follow from the turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"),
        (F.col("turn") % 3).cast("int").alias("section"),
        F.col("turn").cast("int").alias("idx"),
        F.lit(0).alias("sub_idx"),
        F.when(F.col("turn") % 5 == 3, "1h").alias("ttl"),
    )


# --- request bodies --------------------------------------------------------------


def _json(text: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged request per conversation row: (request_id, ts, endpoint, headers, body).

    Turn modulo 4 picks the endpoint. Even conversations carry tools and two reads
    of one file, odd ones plain text. Conversation modulo 5 picks the system prompt.
    """
    c, t = F.col("conv_id"), F.col("turn")
    h = holes()
    quoted = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", _json(F.col("text")).alias("text_json"),
        _json(fill(PY_CODE, **h)).alias("code_json"), _json(fill(CODED, **h)).alias("coded_json"),
    )
    text, code, coded = F.col("text_json"), F.col("code_json"), F.col("coded_json")
    path = F.concat(F.lit('"lib/f'), (c % 3).cast("string"), F.lit('.py"'))
    with_tools = F.concat(
        F.lit('[{"role":"user","content":'), text,
        F.lit('},{"role":"assistant","content":[{"type":"text","text":"Reading"},'
              '{"type":"tool_use","id":"t1","name":"Read","input":{"file_path":'), path,
        F.lit('}}]},{"role":"user","content":[{"type":"tool_result","tool_use_id":"t1","content":'),
        code,
        F.lit('}]},{"role":"assistant","content":[{"type":"tool_use","id":"t2","name":"Read",'
              '"input":{"path":'), path,
        F.lit('}}]},{"role":"user","content":[{"type":"tool_result","tool_use_id":"t2",'
              '"content":[{"type":"text","text":'), code,
        F.lit('}]}]},{"role":"user","content":'), coded, F.lit("}]"),
    )
    plain = F.concat(
        F.lit('[{"role":"user","content":'), text,
        F.lit('},{"role":"assistant","content":"Working on it"},'
              '{"role":"user","content":"go on"},{"role":"assistant","content":'), coded,
        F.lit('},{"role":"user","content":"ok"},{"role":"user","content":'), coded, F.lit("}]"),
    )
    items = F.concat(
        F.lit('[{"role":"user","content":'), coded,
        F.lit('},{"type":"function_call","name":"f","arguments":"{}","call_id":"1"},'
              '{"type":"function_call_output","call_id":"1","output":"done"},'
              '{"role":"user","content":'),
        F.when(c % 7 == 3, F.concat(F.lit('[{"type":"input_text","text":'), text, F.lit("}]")))
        .otherwise(text),
        F.lit("}]"),
    )
    system = (
        F.when(c % 5 == 1, '"system":"  ",')
        .when(c % 5 == 2, '"system":"Focus on g7.js",')
        .when(c % 5 == 3, '"system":[{"type":"text","text":"Focus on"},{"type":"text","text":"lib/f0.py please"}],')
        .when(c % 5 == 4, '"system":[{"type":"text","text":"a","cache_control":{"type":"ephemeral","ttl":"1h"}}],')
        .otherwise("")
    )
    tools = F.when(c % 2 == 0, '"tools":[{"name":"Read"}],').otherwise("")
    model = F.concat(F.lit('"model":'), _json(model_of(c)), F.lit(","))
    body = (
        F.when(
            t % 4 < 2,
            F.concat(
                F.lit("{"), model, system, tools, F.lit('"messages":'),
                F.when(c % 2 == 0, with_tools).otherwise(plain), F.lit("}"),
            ),
        )
        .when(
            t % 4 == 2,
            F.concat(
                F.lit("{"), tools, F.lit('"messages":'),
                F.when(c % 2 == 0, with_tools).otherwise(plain), F.lit("}"),
            ),
        )
        .when(c % 7 == 5, F.concat(F.lit('{"input":'), coded, F.lit("}")))
        .when(c % 7 == 6, F.lit("{broken"))
        .when(c % 7 == 4, F.lit(""))
        .otherwise(F.concat(F.lit("{"), tools, F.lit('"input":'), items, F.lit("}")))
    )
    endpoint = (
        F.when(t % 4 < 2, "/v1/messages")
        .when(t % 4 == 2, "/v1/chat/completions")
        .otherwise("/v1/responses")
    )
    headers = F.create_map(
        F.lit("Host"), F.lit("localhost"),
        F.lit("authorization"), F.concat(F.lit("Bearer "), c.cast("string")),
        F.lit("anthropic-beta"), F.concat(F.lit("b"), t.cast("string")),
        F.lit("chatgpt-account-id"), F.when(c % 2 == 1, c.cast("string")).otherwise(""),
    )
    return quoted.select(
        F.concat_ws("-", c, t).alias("request_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + c * 600 + t * 60).alias("ts"),
        endpoint.alias("endpoint"),
        headers.alias("headers"),
        once(body).alias("body"),
    )


# --- tool traffic -----------------------------------------------------------------


def line_item_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tool results: request = order, file = part modulo 50.

    Positions must be unique in a request. Line number, part and supplier repeat
    together now and then, so the ship date is part of the position.
    """
    wide = lambda name, factor: F.col(name).cast("bigint") * F.lit(factor)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        (
            wide("l_linenumber", 10**18)
            + wide("l_partkey", 10**11)
            + wide("l_suppkey", 10**5)
            + F.unix_date(F.to_date("l_shipdate"))
        ).alias("pos"),
        (F.col("l_partkey") % 50).alias("file"),
    )


def event_tool_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tool calls and results of one long request per user."""
    e = F.col("event_id")
    use = F.col("event_type").isin("click", "view")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"),
        e.alias("pos"),
        F.when(use, "use").otherwise("result").alias("kind"),
        F.when(e % 7 != 0, F.concat(F.lit("t"), e % 3)).alias("tool_id"),
        F.when(use & (e % 5 != 0), F.concat(F.lit("f"), F.floor("value").cast("bigint") % 4, F.lit(".py"))).alias("file"),
    )


EVENT_TRAFFIC_SQL = """
traffic AS (
  SELECT user_id AS request_id, event_id AS pos,
         CASE WHEN event_type IN ('click','view') THEN 'use' ELSE 'result' END AS kind,
         CASE WHEN event_id % 7 <> 0 THEN 't' || (event_id % 3) END AS tool_id,
         CASE WHEN event_type IN ('click','view') AND event_id % 5 <> 0
              THEN 'f' || (CAST(floor(value) AS BIGINT) % 4) || '.py' END AS file
  FROM events)"""


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as commits: one path per user."""
    return table(spark, sf_dir, "events").select(
        F.lit("demo").alias("repo"),
        F.concat(F.lit("pkg/u"), F.col("user_id"), F.lit(".py")).alias("path"),
        F.col("ts").cast("timestamp").alias("commit_ts"),
    )


# --- code corpora ------------------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: folder = source, name = document."""
    return table(spark, sf_dir, "documents").select(
        F.lit("demo").alias("repo"),
        F.concat(F.col("source"), F.lit("/d"), F.col("doc_id"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"),
        "doc_id",
        "source",
    )


def document_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a package tree: every tenth document is its folder's `__init__`."""
    d, src = F.col("doc_id"), F.col("source")
    path = F.when(d % 10 == 0, F.concat(F.lit("p"), d, F.lit("/__init__.py"))).otherwise(
        F.concat(F.lit("p"), d - d % 10, F.lit("/m"), d, F.lit(".py"))
    )
    body = F.concat(
        F.lit('"""'), F.regexp_replace("text", r'[\\"]', ""), F.lit('"""\nimport os, p'),
        d - d % 10, F.lit(".m"), (d * 7 + 1) % 50, F.lit(".deep\n"),
        F.lit("from p"), (d % 20) * 10, F.lit(" import x\n"),
        F.lit("from .m"), d - d % 10 + (d + 1) % 10, F.lit(" import y\n"),
        F.lit("def f(a):\n    return a + "), d, F.lit("\n"),
    )
    broken = F.concat(F.lit("def broken(:\n"), d)
    return table(spark, sf_dir, "documents").select(
        F.lit("demo").alias("repo"),
        path.alias("path"),
        F.when(d % 33 == 32, broken).otherwise(body).alias("content"),
        "doc_id",
    )


def document_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges doc -> (7 doc + 1) mod 200 and doc -> (3 doc + 2) mod 150."""
    d = F.col("doc_id")
    name = lambda c: F.concat(F.lit("d"), c)
    docs = table(spark, sf_dir, "documents")
    return (
        docs.select(
            F.lit("demo").alias("repo"),
            name(d).alias("src"),
            F.explode(F.array(name((d * 7 + 1) % 200), name((d * 3 + 2) % 150))).alias("dst"),
        )
        .where(F.col("src") != F.col("dst"))
        .distinct()
    )
