"""Per-request turn counts and the recent-requests table of a stream.

Sessions live in Spark's state store, one map per session: the first time of each of its
runs to the run's last time and number of requests. A request goes on with the run it
lies near to, whatever else is in the state or in the stream, so late rows and rows with
odd clocks touch their own runs only. Runs that no request has reached for a while of
processing time are let go, each for itself; no maximum over the stream is involved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ctxlens import fixed_values as fv
from ctxlens.operators.accounting import recent

STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Else a query that reads what is there runs empty batches without end for the state's lifetimes.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
KEEP_SECONDS = 24 * 3600
NO_TIME = -(2**63)
SPREAD = 64


class Runs:
    """The runs of one session: intervals more than a gap apart, each with its requests."""

    def __init__(self, runs: dict[int, tuple[int, int]], gap: int) -> None:
        self.runs = dict(runs)  # first: (last, turns)
        self.gap = gap
        self.touched: set[int] = set()
        self.gone: set[int] = set()

    def add(self, times: np.ndarray) -> np.ndarray:
        """The turn of a request at each of the rising times; runs that it connects become one.

        Times of one stretch without a break of more than a gap are added together.
        """
        turns = np.empty(len(times), np.int64)
        breaks = np.flatnonzero(np.diff(times) > self.gap) + 1
        for lo, hi in zip([0, *breaks], [*breaks, len(times)], strict=True):
            at = lo
            while at < hi:
                at = self._extend(times, turns, at, hi)
        return turns

    def _extend(self, times: np.ndarray, turns: np.ndarray, at: int, hi: int) -> int:
        """Number the requests up to the next run that they reach."""
        time = int(times[at])
        near = [f for f, (last, _) in self.runs.items() if f - self.gap <= time <= last + self.gap]
        first, last = min([time, *near]), max([time, *(self.runs[f][0] for f in near)])
        count = sum(self.runs[f][1] for f in near)
        for f in near:
            del self.runs[f]
        self.gone.update(near)
        after = min((f for f in self.runs if f > last), default=None)
        stop = hi if after is None else at + max(1, int(np.searchsorted(times[at:hi], after - self.gap)))
        turns[at:stop] = count + 1 + np.arange(stop - at)
        self.runs[first] = (max(last, int(times[stop - 1])), count + stop - at)
        self.touched.add(first)
        return stop


class TurnCounter(StatefulProcessor):
    """Numbers the requests of a session as they arrive; rows of one batch in order of time.

    A task holds the time and the tie of each row that one session has in one batch.
    """

    def __init__(self, key: str, tie: str, gap_seconds: int, keep_seconds: int) -> None:
        self.key, self.tie = key, tie
        self.gap, self.keep = gap_seconds * 1_000_000, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("runs", "first bigint", "last bigint, turns bigint", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat([r[["time_us", self.tie]] for r in rows])
        batch.insert(0, self.key, key[0])
        batch["turn_count"] = np.int64(0)
        if key[0] is not None:
            batch = batch.sort_values(["time_us", self.tie], kind="stable")
            dated = (batch["time_us"] != NO_TIME).to_numpy()
            times = batch["time_us"].to_numpy(np.int64)[dated]
            runs = Runs({k[0]: tuple(v) for k, v in self.state.iterator()}, self.gap)
            batch.loc[dated, "turn_count"] = runs.add(times)
            for first in runs.gone - runs.runs.keys():
                if self.state.containsKey((first,)):
                    self.state.removeKey((first,))
            for first in runs.touched & runs.runs.keys():
                self.state.updateValue((first,), runs.runs[first])
        yield batch

    def close(self) -> None:
        pass


def turn_stream(
    requests: DataFrame,
    key: str,
    ts: str,
    tie: str,
    gap_seconds: int = fv.SESSION_GAP_SECONDS,
    keep_seconds: int = KEEP_SECONDS,
) -> DataFrame:
    """(key, ts, tie, turn_count) of every request of a stream, as it arrives.

    A request goes on with the run of its session that it lies at most a gap away from, and
    else begins one at 1; one that connects two runs makes them one. Rows that arrive in order
    get the numbers of `sessions.turn_counts`; a late row gets the next number of its run.
    Requests without a key or a time have turn 0; `tie` is never null. A run is kept for `keep_seconds` of
    processing time after its last request, looked at when data arrive. Works in append
    mode; `ts` is a timestamp. Sets the session's state store, and that empty batches wait for data.
    """
    for name, value in STREAM_SETTINGS.items():
        requests.sparkSession.conf.set(name, value)
    types = dict(requests.dtypes)
    # Whole numbers, so that no time is beyond what pandas can hold.
    micros = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(NO_TIME))
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(tie), F.lit(SPREAD))).otherwise(F.lit(0))
    counted = (
        requests.select(F.col(key), F.col(tie), micros.alias("time_us"), spread.alias("_spread"))
        .groupBy(key, "_spread")
        .transformWithStateInPandas(
            TurnCounter(key, tie, gap_seconds, keep_seconds),
            f"`{key}` {types[key]}, time_us bigint, `{tie}` {types[tie]}, turn_count bigint",
            "Append",
            "ProcessingTime",
        )
    )
    time = F.when(F.col("time_us") != NO_TIME, F.timestamp_micros("time_us")).cast(types[ts])
    return counted.select(key, time.alias(ts), tie, "turn_count")


def recent_writer(
    out: str, ts: str, tie: str, n: int = fv.RECENT_REQUESTS
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that keeps the `n` most recent requests in `out`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = recent(batch, ts, tie, n)
        if batch_id > 0:
            before = batch.sparkSession.read.schema(batch.schema).parquet(
                f"{out}/batch={batch_id - 1}"
            )
            rows = recent(rows.unionByName(before), ts, tie, n)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write
