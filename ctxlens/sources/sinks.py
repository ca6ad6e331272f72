"""Writers of rewritten bodies and of metric tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxlens.sources.corpus import _arrow_uri
from ctxlens.sources.parts import Parts


def write_bodies(rewritten: DataFrame, path: str, mode: str = "overwrite") -> None:
    """request_id and body as JSON lines."""
    body = F.to_json(F.struct("request_id", F.col("body")))
    rewritten.select(body.alias("value")).write.mode(mode).text(path)


def write_texts(rows: DataFrame, root: str) -> int:
    """rows(folder, value) as lines of text files, one for each folder and task; gives their number.

    For very many small files: Spark's own writer starts processes for the rights of each
    file in a local folder and moves it twice. A task that is run again writes its files again.
    """
    uri = _arrow_uri(root.rstrip("/"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        name = f"part-{TaskContext.get().partitionId():05}.txt"
        last, out, n = None, None, 0
        for batch in batches:
            values = batch.column("value").cast(pa.binary()).to_pylist()
            for folder, value in zip(batch.column("folder").to_pylist(), values, strict=True):
                if folder != last:
                    if out is not None:
                        out.close()
                    store.create_dir(f"{base}/{folder}", recursive=True)
                    last, out, n = folder, store.open_output_stream(f"{base}/{folder}/{name}"), n + 1
                out.write(value + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    laid = rows.select("folder", F.coalesce("value", F.lit("")).alias("value")).sortWithinPartitions("folder")
    return laid.mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0] or 0


def _by_day(facts: DataFrame, ts: str, files_per_day: int) -> DataFrame:
    """Rows of a day in at most `files_per_day` tasks: few files, and no task with a whole day."""
    salt = F.pmod(F.xxhash64(*facts.columns), F.lit(files_per_day))
    return facts.withColumn("day", F.to_date(ts)).repartition("day", salt)


def append_by_day(
    facts: DataFrame, path: str, ts: str = "ts", mode: str = "append", files_per_day: int = 8
) -> None:
    """Facts as parquet, one folder per day; a second run adds the rows again."""
    _by_day(facts, ts, files_per_day).write.mode(mode).partitionBy("day").parquet(path)


def append_once(
    facts: DataFrame, path: str, key: str, ts: str = "ts", files_per_day: int = 8
) -> bool:
    """Facts as a part of a table by day, known by `key`: a part that is there is not added again.

    Parts are merged as they become many. Tells whether the rows were added.
    """
    parts = Parts(facts.sparkSession, path)
    added = parts.append(_by_day(facts, ts, files_per_day), key, ("day",))
    parts.merge(lambda rows: _by_day(rows.drop("day"), ts, files_per_day), by=("day",))
    return added


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """All facts that `append_once` has added, with their day."""
    return Parts(spark, path).read()
