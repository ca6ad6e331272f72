"""Normalise logged requests into requests, messages, parts and text units.

One request is one log row, so everything up to the message level is a column
expression on that row and needs no shuffle. Message, part and block positions
are kept as keys: list order is part of the meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.functions import variants as V
from ctxlens.functions.text import CODE_BLOCK, file_from_tool_input


def api_of(endpoint: Column) -> Column:
    """chat, messages or responses; `other` for endpoints passed through."""
    table = F.create_map(*[F.lit(x) for kv in fv.ENDPOINT_API.items() for x in kv])
    return F.coalesce(F.try_element_at(table, endpoint), F.lit("other"))


BODY = (
    "model:variant,stream:variant,tools:variant,functions:variant,"
    "tool_choice:variant,system:variant,messages:variant,input:variant"
)
MESSAGE = "role:string,type:string,content:variant"
PART = (
    "type:string,text:string,id:string,tool_use_id:string,name:string,"
    "input:variant,content:variant,cache_control:variant"
)
BLOCK = "type:string,text:string"


def _typed_part(p: Column) -> Column:
    """One part of list content, or one tool or system block, with typed fields."""

    def fields(q: Column) -> Column:
        kind = V.kind(q.content)
        return F.struct(
            q.isNotNull().alias("is_object"),
            F.when(q.isNull(), V.as_text(p)).alias("bare_text"),
            q.type.alias("type"),
            q.text.alias("text"),
            q.id.alias("tool_id"),
            q.tool_use_id.alias("tool_use_id"),
            q.getField("name").alias("tool_name"),
            V.string_map(q.input).alias("tool_input"),
            F.when(V.truthy(q.input), V.as_text(q.input))
            .when(kind == "string", F.try_variant_get(q.content, "$", "string"))
            .alias("extra_text"),
            F.when(kind == "string", F.try_variant_get(q.content, "$", "string")).alias(
                "result_text"
            ),
            F.transform(V.as_list(q.content), lambda b: V.as_struct(b, BLOCK)).alias(
                "result_blocks"
            ),
            q.cache_control.isNotNull().alias("is_marked"),
            V.is_object(q.cache_control).alias("marker_is_object"),
            F.try_variant_get(q.cache_control, "$.ttl", "string").alias("ttl"),
        )

    return V.let(V.as_struct(p, PART), fields)


def _typed_list(v: Column) -> Column:
    return F.transform(V.as_list(v), _typed_part)


def _joined_text(kind: Column, content: Column, parts: Column, separator: str) -> Column:
    """String content, or text parts and bare strings joined."""
    pieces = F.transform(
        parts,
        lambda p: F.when(
            p.is_object & (p.type == "text"), F.coalesce(p.text, F.lit(""))
        ).otherwise(p.bare_text),
    )
    return (
        F.when(kind == "string", F.try_variant_get(content, "$", "string"))
        .when(kind == "list", F.array_join(F.filter(pieces, lambda x: x.isNotNull()), separator))
        .otherwise("")
    )


def _typed_message(m: Column, i: Column) -> Column:
    def with_parts(s: Column) -> Column:
        return V.let(
            F.struct(
                s.alias("s"),
                V.kind(s.content).alias("kind"),
                _typed_list(s.content).alias("parts"),
            ),
            lambda x: F.struct(
                i.cast("int").alias("msg_idx"),
                x.s.isNotNull().alias("is_object"),
                F.when(x.s.isNull(), V.kind(m)).otherwise("object").alias("shape"),
                x.s.type.alias("item_type"),
                x.s.role.alias("role"),
                x.kind.alias("content_kind"),
                _joined_text(x.kind, x.s.content, x.parts, "\n").alias("text"),
                F.when(x.kind == "list", x.parts).alias("parts"),
            ),
        )

    return V.let(V.as_struct(m, MESSAGE), with_parts)


def requests(parsed: DataFrame) -> DataFrame:
    """One row per readable request with its body in typed form.

    requests(request_id, ts, endpoint, headers, api, model, is_stream, tools, system,
    items, offers_tools, chose_tool, input_kind, body). The variant is taken apart
    once; policies, cache plans, messages and parts all read the typed columns.
    """
    default = F.create_map(*[F.lit(x) for kv in fv.DEFAULT_MODEL.items() for x in kv])
    passed = [c for c in ("ts", "endpoint", "headers", "given_id") if c in parsed.columns]
    one_user = F.array(
        F.to_variant_object(
            F.struct(F.lit("user").alias("role"), F.col("b.input").alias("content"))
        )
    )
    listed = F.when(
        F.col("api") == "responses",
        F.when(F.col("input_kind") == "string", one_user).otherwise(
            V.as_list(F.col("b.input"))
        ),
    ).otherwise(V.as_list(F.col("b.messages")))
    choice = F.col("b.tool_choice")
    opened = (
        parsed.where(~F.col("corrupt"))
        .select(
            "request_id",
            *passed,
            api_of(F.col("endpoint")).alias("api"),
            V.as_struct(F.col("body"), BODY).alias("b"),
            "body",
        )
        .withColumn("input_kind", V.kind(F.col("b.input")))
    )
    system = F.struct(
        V.kind(F.col("b.system")).alias("kind"),
        V.as_text(F.col("b.system")).alias("text"),
        _typed_list(F.col("b.system")).alias("blocks"),
    )
    return opened.select(
        "request_id",
        *passed,
        "api",
        F.coalesce(
            V.as_text(F.col("b.model")), F.try_element_at(default, F.col("api")), F.lit("")
        ).alias("model"),
        F.coalesce(F.try_variant_get("b.stream", "$", "boolean"), F.lit(False)).alias(
            "is_stream"
        ),
        _typed_list(F.col("b.tools")).alias("tools"),
        system.alias("system"),
        F.transform(listed, _typed_message).alias("items"),
        (V.truthy(F.col("b.tools")) | V.truthy(F.col("b.functions"))).alias("offers_tools"),
        V.let(
            choice, lambda c: ~V.kind(c).isin("missing", "null") & ~F.coalesce(
                F.try_variant_get(c, "$", "string") == "none", F.lit(False))
        ).alias("chose_tool"),
        "input_kind",
        "body",
    ).withColumn("items", F.coalesce("items", F.array().cast(_items_type())))


def _items_type() -> str:
    block = "struct<type:string,text:string>"
    part = (
        "struct<is_object:boolean,bare_text:string,type:string,text:string,tool_id:string,"
        "tool_use_id:string,tool_name:string,tool_input:map<string,string>,"
        f"extra_text:string,result_text:string,result_blocks:array<{block}>,"
        "is_marked:boolean,marker_is_object:boolean,ttl:string>"
    )
    return (
        "array<struct<msg_idx:int,is_object:boolean,shape:string,item_type:string,"
        f"role:string,content_kind:string,text:string,parts:array<{part}>>>"
    )


def is_skipped_item(m: Column) -> Column:
    """Tool or reasoning item of a responses input."""
    return F.coalesce(m.item_type.isin(fv.RESPONSES_SKIPPED_TYPES), F.lit(False))


def messages(
    reqs: DataFrame, carry: list[str] | None = None, keep_skipped: bool = False
) -> DataFrame:
    """One row per message, plus the system prompt as message -1.

    The system row (`detect_only`) serves file detection alone. Of a responses
    request, items that are no objects are left out, and so are tool and reasoning
    items unless `keep_skipped` keeps them, flagged `is_skipped`; the other items
    keep their index in the input list. `carry` names request columns to repeat.
    """
    carried = carry or []
    passed = [c for c in ("ts",) if c in reqs.columns]
    responses = F.col("api") == "responses"
    system_text = F.when(F.col("system.kind") == "string", F.col("system.text")).when(
        F.col("system.kind") == "list",
        F.array_join(
            F.transform(
                F.filter("system.blocks", lambda b: b.is_object),
                lambda b: F.coalesce(b.text, F.lit("")),
            ),
            " ",
        ),
    )
    opened = reqs.withColumn(
        "_system", F.when(F.col("api") == "messages", system_text)
    )
    item = "m"
    flat = opened.select(
        "request_id", *passed, "api", "model", *carried, "_system",
        F.col("system.kind").alias("_system_kind"),
        F.explode(
            F.when(
                F.coalesce("_system", F.lit("")) != "",
                F.concat(F.array(F.lit(None).cast(_items_type()[6:-1])), "items"),
            ).otherwise(F.col("items"))
        ).alias(item),
    )
    detect = F.col("m").isNull()
    skipped = responses & is_skipped_item(F.col("m"))
    rows = flat.select(
        "request_id",
        *passed,
        "api",
        "model",
        *carried,
        F.when(detect, -1).otherwise(F.col("m.msg_idx")).alias("msg_idx"),
        F.when(detect, "system")
        .otherwise(F.coalesce("m.role", F.when(responses, "user").otherwise("")))
        .alias("role"),
        (detect | F.col("m.is_object")).alias("is_object"),
        F.coalesce(skipped, F.lit(False)).alias("is_skipped"),
        F.when(detect, F.col("_system_kind")).otherwise(F.col("m.content_kind")).alias(
            "content_kind"
        ),
        F.when(detect, F.col("_system")).otherwise(F.col("m.text")).alias("text"),
        "m.parts",
        detect.alias("detect_only"),
    )
    kept = F.lit(True) if keep_skipped else ~F.col("is_skipped")
    return rows.where((F.col("api") != "responses") | (F.col("is_object") & kept))


def parts(msgs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per part of list content, objects only."""
    p = F.col("p")
    return (
        msgs.where(~F.col("detect_only") & (F.col("content_kind") == "list"))
        .select(
            "request_id",
            *(carry or []),
            "msg_idx",
            "role",
            F.posexplode("parts").alias("part_idx", "p"),
        )
        .where(p.is_object)
        .select(
            "request_id",
            *(carry or []),
            "msg_idx",
            "part_idx",
            position(F.col("msg_idx"), F.col("part_idx")).alias("pos"),
            "role",
            *[
                p[name].alias(name)
                for name in (
                    "type", "text", "tool_id", "tool_use_id", "tool_name", "tool_input",
                    "result_text", "result_blocks", "is_marked", "ttl",
                )
            ],
        )
    )


def position(msg_idx: Column, part_idx: Column) -> Column:
    """Place of a part in a request as one number, ordered as the two indexes are."""
    return F.shiftleft(msg_idx.cast("bigint"), 31) + part_idx.cast("bigint")


def tool_events(part_rows: DataFrame) -> DataFrame:
    """Tool calls and results without their texts: the input of the stale-read operators."""
    is_use = F.col("type") == "tool_use"
    return part_rows.where(F.col("type").isin(fv.TOOL_PART_TYPES)).select(
        "request_id",
        "pos",
        F.when(is_use, "use").otherwise("result").alias("kind"),
        F.when(is_use, F.col("tool_id")).otherwise(F.col("tool_use_id")).alias("tool_id"),
        F.when(is_use, file_from_tool_input(F.col("tool_input"))).alias("file"),
    )


def text_units(
    msgs: DataFrame, tool_aware: Column | bool = False, carry: list[str] | None = None
) -> DataFrame:
    """Countable texts: units(request_id, model, msg_idx, part_idx, text, editable).

    `part_idx` is -1 for string content. The plain path leaves whole messages of
    tool roles alone; the tool-aware path only leaves their string content alone.
    """
    aware = tool_aware if isinstance(tool_aware, Column) else F.lit(tool_aware)
    own = msgs.where(~F.col("detect_only") & F.col("content_kind").isin("string", "list"))
    editable = F.when(
        aware,
        ~((F.col("content_kind") == "string") & F.col("role").isin(fv.TOOL_ROLES)),
    ).otherwise(~F.col("role").isin(fv.UNTOUCHED_ROLES))
    whole = F.array(F.struct(F.lit(-1).alias("part_idx"), F.col("text").alias("text")))
    if "parts" in msgs.columns:
        texts = F.filter(
            F.transform(
                "parts",
                lambda p, i: F.struct(
                    i.cast("int").alias("part_idx"),
                    F.when(p.is_object & (p.type == "text"), p.text).alias("text"),
                ),
            ),
            lambda e: e.text.isNotNull(),
        )
        entries = F.when(F.col("content_kind") == "string", whole).otherwise(texts)
    else:
        entries = F.when(F.col("content_kind") == "string", whole)
    return own.select(
        "request_id",
        "model",
        *(carry or []),
        "msg_idx",
        editable.alias("editable"),
        F.inline(entries),
    )


def last_user_text(msgs: DataFrame) -> DataFrame:
    """Text of each request's last user message, code blocks taken out."""
    own = msgs.where((F.col("role") == "user") & ~F.col("detect_only"))
    last = own.groupBy("request_id").agg(F.max_by("text", "msg_idx").alias("text"))
    return last.withColumn("text", F.regexp_replace("text", CODE_BLOCK, ""))
