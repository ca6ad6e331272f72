"""Small helpers that the operators share: Arrow columns, row keys, table reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlens.runtime import apply_settings, stage

__all__ = ["bytes_of", "fresh", "map_rows", "row_key", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return apply_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def row_key(text: str = "text") -> Column:
    """Tells rows with the same number but other texts apart; a null text has its own key."""
    return F.coalesce(F.xxhash64(F.col(text)), F.lit(0))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch; it returns the columns of `schema`."""
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type) for f in fields], schema=fields
                )

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def fresh(df: DataFrame, name: str) -> str:
    """The name with as many underscores before it as keep it apart from the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
