"""Report columns: figures as short text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens_text(count: Column) -> Column:
    return (
        F.when(count >= 1_000_000, F.format_string("%.1fM", count / F.lit(1e6)))
        .when(count >= 1_000, F.format_string("%.1fk", count / F.lit(1e3)))
        .otherwise(count.cast("string"))
    )


def money_text(amount: Column) -> Column:
    return F.format_string("$%.2f", amount)


def duration_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(whole / 3600).cast("bigint"),
        F.floor(whole % 3600 / 60).cast("bigint"),
        whole % 60,
    )


def bar_text(ratio: Column, width: int = 20) -> Column:
    filled = (ratio * width).cast("int")
    return F.concat(
        F.repeat(F.lit("█"), filled),
        F.repeat(F.lit("░"), F.lit(width) - filled),
        F.format_string(" %.1f%%", ratio * 100),
    )
