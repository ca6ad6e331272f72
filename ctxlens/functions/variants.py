"""Helpers for JSON of unknown shape held as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


KINDS = {"VOID": "null", "ARRAY": "list", "OBJECT": "object", "STRING": "string"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it.

    Expressions that repeat a large sub-expression grow with every level of
    nesting; a lambda variable keeps them small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def field(v: Column, name: str) -> Column:
    """Sub-value; SQL NULL where the key is missing, a variant null where it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_struct(v: Column, schema: str) -> Column:
    """Typed fields of an object; NULL for any other value."""
    return F.try_variant_get(v, "$", f"struct<{schema}>")


def is_object(v: Column) -> Column:
    return as_struct(v, "_:variant").isNotNull()


def kind(v: Column) -> Column:
    """missing, null, list, object, string, or other (numbers, booleans)."""
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return let(
        F.substring_index(F.schema_of_variant(v), "<", 1),
        lambda name: F.when(name.isNull(), "missing").otherwise(
            F.coalesce(F.try_element_at(table, name), F.lit("other"))
        ),
    )


def as_text(v: Column) -> Column:
    """The string held by a variant, NULL for any other type."""
    return let(
        v, lambda x: F.when(kind(x) == "string", F.try_variant_get(x, "$", "string"))
    )


def with_key(obj: Column, key: str, value: Column) -> Column:
    """Copy of an object variant with one key set."""
    rest = F.map_filter(as_map(obj), lambda k, _: k != key)
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(key), value)))


def without_key(obj: Column, key: str) -> Column:
    return F.to_variant_object(F.map_filter(as_map(obj), lambda k, _: k != key))


def string_map(v: Column) -> Column:
    """MAP<STRING, STRING> of an object's string values; other values dropped."""
    entries = F.filter(
        F.map_entries(as_map(v)), lambda e: kind(e.value) == "string"
    )
    return F.map_from_entries(
        F.transform(
            entries,
            lambda e: F.struct(e.key, F.try_variant_get(e.value, "$", "string")),
        )
    )


def truthy(v: Column) -> Column:
    """JSON value that Python would call true, judged by its text."""
    empty = ["", "[]", "{}", "0", "0.0", "false"]
    return let(
        F.try_variant_get(v, "$", "string"),
        lambda text: text.isNotNull() & ~text.isin(empty),
    )
