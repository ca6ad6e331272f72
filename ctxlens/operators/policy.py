"""Which requests use tools, how they may be compacted, where they were sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.operators.messages import is_skipped_item


def has_tools() -> Column:
    """Tools offered, a tool choice made, or tool traffic in the history.

    Read from the typed columns of `messages.requests`; the history of a responses
    request is not looked at.
    """
    traffic = F.exists(
        "items",
        lambda m: F.coalesce(m.role.isin(fv.TOOL_ROLES), F.lit(False))
        | F.coalesce(
            F.exists(m.parts, lambda p: F.coalesce(p.type.isin(fv.TOOL_PART_TYPES), F.lit(False))),
            F.lit(False),
        ),
    )
    return F.col("offers_tools") | F.col("chose_tool") | (
        (F.col("api") != "responses") & traffic
    )


def policy(
    api: Column,
    tools: Column,
    typed_parts: Column,
    passthrough: bool = False,
    compress_with_tools: bool = True,
) -> Column:
    """none, plain or tool_aware."""
    blocked = F.lit(passthrough) | (api == "other") | (
        tools & F.lit(not compress_with_tools)
    )
    return (
        F.when(blocked, "none")
        .when(
            api == "responses", F.when(typed_parts, "none").otherwise("plain")
        )
        .when(tools, "tool_aware")
        .otherwise("plain")
    )


def typed_parts() -> Column:
    """A responses input has an item whose content is not a string.

    A missing content counts as the empty string.
    """
    return (F.col("api") == "responses") & F.exists(
        "items",
        lambda m: m.is_object
        & ~is_skipped_item(m)
        & ~m.content_kind.isin("string", "missing"),
    )


def request_policy(
    reqs: DataFrame, passthrough: bool = False, compress_with_tools: bool = True
) -> DataFrame:
    """requests with `has_tools`, `has_typed_parts` and `policy`."""
    return (
        reqs.withColumn("has_tools", has_tools())
        .withColumn("has_typed_parts", typed_parts())
        .withColumn(
            "policy",
            policy(
                F.col("api"),
                F.col("has_tools"),
                F.col("has_typed_parts"),
                passthrough,
                compress_with_tools,
            ),
        )
    )


def route_label(endpoint: Column, headers: Column) -> Column:
    """anthropic, subscription or openai."""
    account = F.coalesce(F.try_element_at(headers, F.lit(fv.SUBSCRIPTION_HEADER)), F.lit(""))
    return (
        F.when(endpoint.startswith("/v1/messages"), "anthropic")
        .when(account != "", "subscription")
        .otherwise("openai")
    )


def endpoint_class(endpoint: Column) -> Column:
    return F.when(endpoint.isin(list(fv.ENDPOINT_API)), "compressible").otherwise(
        "pass_through"
    )


def upstream_path(path: Column, headers: Column, query: Column) -> Column:
    """Path as sent on: `/v1` dropped for subscription traffic, query string kept."""
    short = F.when(
        route_label(path, headers) == "subscription",
        F.regexp_replace(path, r"^/?v1/", "/"),
    ).otherwise(path)
    return F.when(F.coalesce(query, F.lit("")) == "", short).otherwise(
        F.concat(short, F.lit("?"), query)
    )


def forwarded_headers(headers: Column, redact: str = "[redacted]") -> Column:
    """Headers that go on to an OpenAI-style endpoint, secrets blanked out."""
    kept = F.map_filter(headers, lambda k, _: ~F.lower(k).isin(fv.DROPPED_HEADERS))
    safe = F.transform_values(
        kept,
        lambda k, v: F.when(
            F.lower(k).isin(fv.SECRET_HEADERS) | F.lower(k).rlike("cookie|account|session"), redact
        ).otherwise(v),
    )
    return F.map_concat(
        safe, F.create_map(F.lit("Content-Type"), F.lit(fv.JSON_CONTENT_TYPE))
    )


def anthropic_headers(headers: Column) -> Column:
    """Feature headers that go on to a messages endpoint, with a version default."""
    version = F.coalesce(
        F.try_element_at(headers, F.lit("anthropic-version")), F.lit(fv.ANTHROPIC_VERSION)
    )
    features = F.map_filter(
        headers,
        lambda k, _: k.startswith("anthropic-") & (k != "anthropic-version"),
    )
    fixed = F.create_map(
        F.lit("Content-Type"),
        F.lit(fv.JSON_CONTENT_TYPE),
        F.lit("anthropic-version"),
        version,
    )
    return F.map_concat(fixed, features)
