"""Tables that grow by parts, each counted once however often it is written.

A part is a parquet folder of its own. It belongs to the table from the moment a one-row
file of the ledger names it; that file appears whole or not at all, so readers see a part
or they do not, and a job that dies leaves nothing they would read. A part has a key, for
instance the number of a stream's batch: a second part of that key is not added. Many
small parts are merged into one of the next level, which takes their place in the same way,
so a table of n parts is read from about log n.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ctxlens.runtime import remove

LEDGER = "key string, path string, level int, replaces array<string>"
FAN = 8
NAME = "part_id"


@dataclass(frozen=True)
class Part:
    key: str
    path: str
    level: int


class Parts:
    """The parts of one table below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _rows(self) -> list:
        """The ledger: one short row per part that was ever added."""
        ledger = f"{self.folder}/ledger"
        if not _exists(self.spark, ledger):
            return []
        rows = self.spark.read.schema(LEDGER).json(f"{ledger}/*").collect()
        # Of two parts of one key, written at the same time, the same one counts for all readers.
        first: dict[str, object] = {}
        for row in sorted(rows, key=lambda r: r.path):
            first.setdefault(row.key, row)
        return list(first.values())

    def live(self) -> list[Part]:
        """Parts that make up the table now."""
        rows = self._rows()
        gone = {p for r in rows for p in r.replaces or ()}
        return [Part(r.key, r.path, r.level) for r in rows if r.path not in gone]

    def has(self, key: str) -> bool:
        return any(r.key == key for r in self._rows())

    def _add(self, df: DataFrame, key: str, level: int, replaces: list[str], by: tuple[str, ...]) -> None:
        path = f"{NAME}=p{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(f"{self.folder}/{path}")
        row = self.spark.createDataFrame([(key, path, level, replaces)], LEDGER)
        row.coalesce(1).write.json(f"{self.folder}/ledger/{path}")

    def append(self, df: DataFrame, key: str | None = None, by: tuple[str, ...] = ()) -> bool:
        """Add the rows as a part, unless a part of that key is there; tells whether it did."""
        if key is None:
            key = uuid.uuid4().hex
        elif self.has(key):
            return False
        self._add(df, key, 0, [], by)
        return True

    def read(self, schema: str | None = None) -> DataFrame:
        """All rows; a table without parts needs a schema."""
        parts = self.live()
        if parts:
            return self._read(parts, schema)
        if schema is None:
            raise ValueError(f"no parts in {self.folder}")
        return self.spark.createDataFrame([], schema)

    def _read(self, parts: list[Part], schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        paths = (f"{self.folder}/{p.path}" for p in parts)
        return reader.option("basePath", self.folder).parquet(*paths).drop(NAME)

    def merge(self, combine: Callable[[DataFrame], DataFrame], fan: int = FAN, by: tuple[str, ...] = ()) -> None:
        """Put `combine` of all parts of a level in their place where there are `fan` or more."""
        while True:
            levels: dict[int, list[Part]] = {}
            for part in self.live():
                levels.setdefault(part.level, []).append(part)
            full = [n for n, parts in sorted(levels.items()) if len(parts) >= fan]
            if not full:
                return
            parts = levels[full[0]]
            paths = sorted(p.path for p in parts)
            self._add(combine(self._read(parts)), f"merged-{uuid.uuid4().hex}", full[0] + 1, paths, by)

    def vacuum(self) -> int:
        """Remove parts that others have replaced; only when nobody reads an older state."""
        live = {p.path for p in self.live()}
        gone = [r.path for r in self._rows() if r.path not in live]
        return sum(remove(self.spark, f"{self.folder}/{path}") for path in gone)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
