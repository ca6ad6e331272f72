"""Where prompt-cache markers belong in a request and what they make reusable.

The body form plans a whole request with column expressions on its one row and
needs no shuffle. The flat forms answer single questions on message or marker
tables with aggregates that reduce before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.functions import variants as V
from ctxlens.functions.text import strip
from ctxlens.operators.ordered import last_positions

TOOLS, SYSTEM, MESSAGES = 0, 1, 2


# --- body form -------------------------------------------------------------------


def _owners(blocks: Column, section: int, outer: Column | None = None) -> Column:
    """Markers found on the objects of one typed list."""

    def entry(p: Column, i: Column) -> Column:
        idx, sub = (i, F.lit(0)) if outer is None else (outer, i)
        return F.when(
            p.is_object & p.is_marked,
            F.struct(
                F.lit(section).alias("section"),
                idx.cast("int").alias("idx"),
                sub.cast("int").alias("sub_idx"),
                p.ttl.alias("ttl"),
                p.marker_is_object.alias("is_object"),
            ),
        )

    return F.filter(F.transform(blocks, entry), lambda m: m.isNotNull())


def existing_markers() -> Column:
    """All markers of a request in processing order: tools, system, messages."""
    none = F.array().cast(
        "array<struct<section:int,idx:int,sub_idx:int,ttl:string,is_object:boolean>>"
    )
    in_messages = F.flatten(
        F.transform(
            "items", lambda m, i: F.coalesce(_owners(m.parts, MESSAGES, i), none)
        )
    )
    return F.concat(
        F.coalesce(_owners(F.col("tools"), TOOLS), none),
        F.coalesce(_owners(F.col("system.blocks"), SYSTEM), none),
        F.coalesce(in_messages, none),
    )


def _last_index(values: Column, keep) -> Column:
    """Index of the last element that `keep` accepts, NULL if none."""
    hits = F.filter(
        F.transform(values, lambda v, i: F.when(keep(v), i)), lambda i: i.isNotNull()
    )
    return F.array_max(hits)


def _if_unmarked(values: Column, index: Column) -> Column:
    """The index, unless there is none or its block already has a marker."""
    return V.let(index, lambda i: F.when(~F.get(values, i).is_marked, i))


def _tool_target() -> Column:
    """The last tool, if it is an object without a marker."""
    tools = F.col("tools")
    last = F.size(tools) - 1
    return F.when(F.get(tools, last).is_object, _if_unmarked(tools, last))


def _system_target() -> Column:
    """Block to mark; 0 for a string prompt that becomes a one-block list."""
    blocks = F.col("system.blocks")
    return F.when(
        F.col("system.kind") == "string",
        F.when(strip(F.col("system.text")) != "", 0),
    ).otherwise(_if_unmarked(blocks, _last_index(blocks, lambda b: b.is_object)))


def _head() -> Column:
    kept = F.greatest(F.size("items") - fv.TRAILING_MESSAGES, F.lit(0))
    return F.slice("items", 1, kept)


def _prefix_target() -> Column:
    """STRUCT<idx, sub> of the block to mark in the prefix's last message, or NULL."""

    def block_of(m: Column) -> Column:
        last = _last_index(
            m.parts,
            lambda p: p.is_object
            & (p.is_marked | F.coalesce(p.type.isin(fv.TAGGABLE_TYPES), F.lit(False))),
        )
        return F.when(
            m.content_kind == "string", F.when(m.text != "", 0)
        ).otherwise(_if_unmarked(m.parts, last))

    message = F.get("items", _last_index(_head(), lambda m: m.is_object))
    return V.let(
        message, lambda m: F.struct(m.msg_idx.alias("idx"), block_of(m).alias("sub"))
    )


def _start(text: Column, length: int | None) -> Column:
    return text if length is None else F.substring(text, 1, length)


def fingerprint(
    chars: int | None = None, blocks: int | None = None, block_chars: int | None = None
) -> Column:
    """Session id: hash of the opening messages as logged, before any marking.

    Whole messages count; the limits take the first `chars` of a plain text and the
    first `block_chars` of the first `blocks` blocks of a list.
    """

    def block_pieces(p: Column) -> Column:
        return F.when(
            p.is_object,
            F.array(
                F.coalesce(p.type, F.lit("")),
                _start(F.coalesce(p.text, F.lit("")), block_chars),
            ),
        ).otherwise(F.array().cast("array<string>"))

    def message_pieces(m: Column) -> Column:
        parts = m.parts if blocks is None else F.slice(m.parts, 1, blocks)
        listed = F.flatten(F.transform(parts, block_pieces))
        none = F.array().cast("array<string>")
        body = F.when(
            m.content_kind == "string",
            F.array(_start(m.text, chars)),
        ).otherwise(F.coalesce(listed, none))
        return F.when(
            m.is_object, F.concat(F.array(F.coalesce(m.role, F.lit(""))), body)
        ).otherwise(F.array(F.concat(F.lit("<"), m["shape"], F.lit(">"))))

    pieces = F.flatten(
        F.transform(F.slice("items", 1, fv.FINGERPRINT_MESSAGES), message_pieces)
    )
    return F.substring(F.sha2(F.array_join(pieces, "\x1f"), 256), 1, fv.FINGERPRINT_HEX)


def cached_prefix_tokens() -> Column:
    """Characters before the trailing messages, four to a token."""
    zero = F.lit(0).cast("bigint")

    def chars(text: Column) -> Column:
        return F.coalesce(F.length(text).cast("bigint"), zero)

    def message_chars(m: Column) -> Column:
        listed = F.aggregate(
            F.filter(m.parts, lambda p: p.is_object),
            zero,
            lambda acc, p: acc + chars(p.text) + chars(p.extra_text),
        )
        return F.when(m.content_kind == "string", chars(m.text)).otherwise(
            F.coalesce(listed, zero)
        )

    total = F.aggregate(_head(), zero, lambda acc, m: acc + message_chars(m))
    return F.floor(total / fv.CHARS_PER_TOKEN).cast("bigint")


def promote_ttls(markers: Column) -> Column:
    """Give every marker at or before the last one-hour marker that lifetime."""
    last = _last_index(markers, lambda m: m.is_object & (m.ttl == fv.LONG_TTL))
    return V.let(
        last,
        lambda n: F.transform(
            markers,
            lambda m, i: F.struct(
                m.section.alias("section"),
                m.idx.alias("idx"),
                m.sub_idx.alias("sub_idx"),
                F.when(m.is_object & (i <= n), F.lit(fv.LONG_TTL)).otherwise(m.ttl).alias("ttl"),
                m.is_object.alias("is_object"),
            ),
        ),
    )


def _new(section: int, idx: Column, sub: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        idx.cast("int").alias("idx"),
        sub.cast("int").alias("sub_idx"),
        F.lit(None).cast("string").alias("ttl"),
        F.lit(True).alias("is_object"),
    )


def plan_requests(reqs: DataFrame) -> DataFrame:
    """requests with their cache plan: `existing`, `breakpoints`, `prefix_end_index`,
    `session_id`, `cached_tokens_estimate` and the final `markers`.

    Surplus markers are cut from the end first. Then the last tool, the system
    prompt and the conversation prefix are marked, each while the budget lasts.
    What can be marked is found first; the budget then keeps the first of those.
    """
    big_enough = F.size("items") >= fv.MIN_MESSAGES_TO_CACHE
    wishes = V.let(
        F.struct(
            _tool_target().alias("tool"),
            _system_target().alias("system"),
            _prefix_target().alias("prefix"),
        ),
        lambda t: F.filter(
            F.array(
                F.when(t.tool.isNotNull(), _new(TOOLS, t.tool, F.lit(0))),
                F.when(t.system.isNotNull(), _new(SYSTEM, t.system, F.lit(0))),
                F.when(t.prefix["sub"].isNotNull(), _new(MESSAGES, t.prefix.idx, t.prefix["sub"])),
            ),
            lambda m: m.isNotNull(),
        ),
    )
    placed = V.let(
        existing_markers(),
        lambda found: F.struct(
            F.slice(found, 1, fv.MAX_MARKERS).alias("kept"),
            F.when(
                big_enough,
                F.slice(wishes, F.lit(1), F.greatest(F.lit(fv.MAX_MARKERS) - F.size(found), F.lit(0))),
            )
            .otherwise(F.slice(found, 1, 0))
            .alias("new"),
        ),
    )
    fits = reqs.withColumn("_p", placed)
    prefix = F.filter("_p.new", lambda m: m.section == MESSAGES)
    return fits.withColumns(
        {
            "n_messages": F.size("items"),
            "existing": F.size("_p.kept"),
            "breakpoints": F.size("_p.new"),
            "prefix_end_index": F.coalesce(F.get(prefix, F.lit(0)).idx, F.lit(-1)),
            "session_id": F.when(big_enough, fingerprint()),
            "cached_tokens_estimate": F.when(big_enough, cached_prefix_tokens()).otherwise(
                F.lit(0).cast("bigint")
            ),
            "markers": promote_ttls(_sorted(F.concat("_p.kept", "_p.new"))),
        }
    ).drop("_p")


def _sorted(markers: Column) -> Column:
    """Markers in processing order; a system string's marker sits on block 0."""
    return F.array_sort(markers)


def _remarked(v: Column, hit: Column) -> Column:
    """Object with the cache marker the plan gives it, or with none."""
    fresh = F.parse_json(F.lit(fv.MARKER_JSON))

    def apply(x: Column) -> Column:
        cache = V.let(
            F.coalesce(V.field(x.v, "cache_control"), fresh),
            lambda own: F.when(
                V.is_object(own) & x.hit.ttl.isNotNull(),
                V.with_key(own, "ttl", x.hit.ttl.cast("variant")),
            ).otherwise(own),
        )
        return (
            F.when(x.hit.isNotNull(), V.with_key(x.v, "cache_control", cache))
            .when(
                V.field(x.v, "cache_control").isNotNull(), V.without_key(x.v, "cache_control")
            )
            .otherwise(x.v)
        )

    return F.when(
        V.is_object(v), V.let(F.struct(v.alias("v"), hit.alias("hit")), apply)
    ).otherwise(v)


def _text_block(text: Column) -> Column:
    return F.to_variant_object(
        F.struct(F.lit("text").alias("type"), text.alias("text"))
    )


def _hit(markers: Column, section: int, idx: Column, sub: Column) -> Column:
    return F.get(
        F.filter(
            markers,
            lambda m: (m.section == section)
            & (m.idx == idx.cast("int"))
            & (m.sub_idx == sub.cast("int")),
        ),
        F.lit(0),
    )


def marked_bodies(planned: DataFrame, where: Column | None = None) -> DataFrame:
    """Planned requests whose `body` carries the planned markers.

    Values without a marker to add, drop or promote are passed through as they
    are, and so are whole bodies of requests that `where` leaves out.
    """
    chosen = F.lit(True) if where is None else where
    markers, body = F.col("markers"), F.col("body")

    def blocks(values: Column, section: int, outer: Column | None = None) -> Column:
        def one(v: Column, i: Column) -> Column:
            idx, sub = (i, F.lit(0)) if outer is None else (outer, i)
            return _remarked(v, _hit(markers, section, idx, sub))

        return F.transform(values, one)

    def message(m: Column, i: Column) -> Column:
        typed = F.get("items", i)
        planned_here = F.exists(
            markers, lambda k: (k.section == MESSAGES) & (k.idx == i.cast("int"))
        )
        marked_here = F.exists(typed.parts, lambda p: p.is_object & p.is_marked)
        listed = F.when(
            typed.content_kind == "string", F.array(_text_block(typed.text))
        ).otherwise(V.as_list(V.field(m, "content")))
        return F.when(
            planned_here | F.coalesce(marked_here, F.lit(False)),
            V.with_key(m, "content", F.to_variant_object(blocks(listed, MESSAGES, i))),
        ).otherwise(m)

    in_system = F.exists(markers, lambda k: k.section == SYSTEM)
    system_list = F.when(
        F.col("system.kind") == "string",
        F.when(in_system, F.array(_text_block(F.col("system.text")))),
    ).otherwise(V.as_list(V.field(body, "system")))
    changed = {
        "tools": blocks(V.as_list(V.field(body, "tools")), TOOLS),
        "system": blocks(system_list, SYSTEM),
        "messages": F.transform(V.as_list(V.field(body, "messages")), message),
    }
    fresh = F.map_filter(
        F.create_map(
            *[
                x
                for name, value in changed.items()
                for x in (F.lit(name), F.to_variant_object(value))
            ]
        ),
        lambda _, v: v.isNotNull(),
    )
    kept = V.let(
        fresh,
        lambda new: F.to_variant_object(
            F.map_concat(
                F.map_filter(V.as_map(body), lambda k, _: ~F.array_contains(F.map_keys(new), k)),
                new,
            )
        ),
    )
    return planned.withColumn("body", F.when(chosen, kept).otherwise(body))


# --- flat forms ------------------------------------------------------------------


def prefix_estimate(msgs: DataFrame) -> DataFrame:
    """Per request: message count, cut-off index and cached-token estimate.

    `msgs` has request_id, gap-free msg_idx and n_chars. An empty message at the
    cut-off takes no marker, so there is no index then. The characters of the cut-off
    and trailing messages come from the last positions; the trailing ones are taken
    off the sum.
    """
    tails = last_positions(fv.TRAILING_MESSAGES + 1, "msg_idx", F.col("n_chars"))
    names = [f"_tail{i}" for i in range(len(tails))]
    sums = msgs.groupBy("request_id").agg(
        F.count("*").alias("n_messages"),
        F.sum("n_chars").alias("_chars"),
        *[t.alias(n) for t, n in zip(tails, names)],
    )
    last = F.array(*[F.coalesce(n, F.lit(0)) for n in names])
    cut_off = F.get(last, (F.col("n_messages") % len(tails)).cast("int"))
    tail = sum((F.coalesce(n, F.lit(0)) for n in names), F.lit(0)) - cut_off
    big = F.col("n_messages") >= fv.MIN_MESSAGES_TO_CACHE
    return sums.select(
        "request_id",
        "n_messages",
        F.when(big & (cut_off > 0), F.col("n_messages") - fv.TRAILING_MESSAGES - 1)
        .otherwise(-1)
        .cast("bigint")
        .alias("prefix_end_index"),
        F.when(big, F.floor((F.col("_chars") - tail) / fv.CHARS_PER_TOKEN))
        .otherwise(0)
        .cast("bigint")
        .alias("cached_tokens_estimate"),
    )


def flat_fingerprint(msgs: DataFrame, chars: int | None = None) -> DataFrame:
    """Session id per request from (request_id, msg_idx, role, text); string content.

    Whole texts count, or the first `chars` of each.
    Only the opening messages leave the scan, so a request sends two rows at most.
    """
    head = msgs.where(F.col("msg_idx") < fv.FINGERPRINT_MESSAGES).select(
        "request_id",
        "msg_idx",
        F.concat_ws("\x1f", "role", _start(F.col("text"), chars)).alias("_p"),
    )
    joined = head.groupBy("request_id").agg(
        *[
            F.max(F.when(F.col("msg_idx") == i, F.col("_p"))).alias(f"_p{i}")
            for i in range(fv.FINGERPRINT_MESSAGES)
        ]
    )
    pieces = F.concat_ws("\x1f", *[f"_p{i}" for i in range(fv.FINGERPRINT_MESSAGES)])
    return joined.select(
        "request_id",
        F.substring(F.sha2(pieces, 256), 1, fv.FINGERPRINT_HEX).alias("session_id"),
    )


def within_budget(markers: DataFrame, budget: int = fv.MAX_MARKERS) -> DataFrame:
    """First `budget` markers per request; surplus rows go before the shuffle."""
    order = W.partitionBy("request_id").orderBy("section", "idx", "sub_idx")
    return (
        markers.withColumn("marker_no", F.row_number().over(order))
        .where(F.col("marker_no") <= budget)
    )


def promoted(markers: DataFrame) -> DataFrame:
    """markers with the one-hour lifetime carried to all earlier ones of a request."""
    place = F.struct("section", "idx", "sub_idx")
    last = (
        markers.where(F.col("ttl") == fv.LONG_TTL)
        .groupBy("request_id")
        .agg(F.max(place).alias("_last"))
    )
    return (
        markers.join(last, "request_id", "left")
        .withColumn(
            "ttl", F.when(place <= F.col("_last"), F.lit(fv.LONG_TTL)).otherwise(F.col("ttl"))
        )
        .drop("_last")
    )


def marker_counts(markers: DataFrame) -> DataFrame:
    return markers.groupBy("request_id").agg(F.count("*").alias("n_markers"))
