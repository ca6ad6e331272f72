"""Keep an expensive expression from being computed more than once per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column) -> Column:
    """The value as a one-row generator.

    The optimizer copies an ordinary expression into every filter and column that
    uses it. It does not look through a generator, so the value is made once.
    """
    return F.explode(F.array(value))


def once_if(value: Column, keep) -> Column:
    """As `once`, but without a row where `keep` of the value does not hold."""
    return F.explode(F.filter(F.array(value), keep))
