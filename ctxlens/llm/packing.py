"""Best-fit packing of tokenized documents into sequences of a fixed length.

The configuration linear program over the length histogram (at most `size` lengths,
whatever the corpus) is solved by multiplicative weights: every length has a price,
a knapsack dynamic program finds the fullest-priced configuration, the configuration
takes a share of its lengths, and the prices of what was taken fall. Shares are
rounded down to whole sequences as they are taken; what is left over is packed best
fit, longest first, over counts. The plan says for every length which ranks go
where, so each piece finds its place by its length and its rank within the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens.llm.tables import _arrow_schema, map_rows, stage
from ctxlens.llm.tokens import encoder

SIZE = 1024
AT_ONCE = 6 << 20
END_ID = 2
ROUNDS = 500
SHARE = 0.5
BONUS = 0.4


def pieces(
    docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32, part, nth (and ids).

    A document is its ids and `end_id`. Only documents longer than `size` are cut;
    the first piece takes what is over a multiple of `size`. `nth` numbers a task's
    pieces of one length. A null text is empty, so it is the end id alone.
    """
    schema = (
        "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
        + ", ids binary" * with_ids
    )
    fields = _arrow_schema(docs.sparkSession, schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch, texts in _tokenized(batches, vocabulary):
            rows = {f.name: [] for f in fields}
            numbers = batch.column("doc_id").to_pylist()
            for number, ids in zip(numbers, texts, strict=True):
                ids += end
                total = len(ids) // 4
                cuts = [0, *range(total % size or size, total + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    row = (number, k, a, b - a, zlib.crc32(own), part, seen[b - a], own)
                    seen[b - a] += 1
                    for name, value in zip(rows, row, strict=False):
                        rows[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[f.name], f.type) for f in fields], schema=fields
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _tokenized(
    batches: Iterator[pa.RecordBatch], vocabulary: str
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with the ids of their texts; about `AT_ONCE` bytes are tokenized together."""
    group, held = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            group.append(batch)
            held += batch.column("text").nbytes
        if group and (batch is None or held >= AT_ONCE):
            texts = [x.column("text").cast(pa.large_string()) for x in group]
            ids = iter(encoder(vocabulary).ids(pa.concat_arrays(texts)))
            for x in group:
                yield x, list(islice(ids, x.num_rows))
            group, held = [], 0


def _fullest(prices: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Knapsack by dynamic programming: how often each length is in the dearest configuration."""
    dense = np.full(size + 1, -1.0)
    dense[lengths] = prices
    best = np.zeros(size + 1)
    pick = np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        worth = dense[1 : room + 1] + best[room - 1 :: -1]
        top = worth.argmax()
        if worth[top] > best[room - 1]:
            pick[room], best[room] = top + 1, worth[top]
        else:
            best[room] = best[room - 1]
    taken, room = np.zeros(size + 1, np.int64), size
    while room > 0:
        taken[pick[room]] += 1
        room -= pick[room] or 1
    return taken[lengths]


def solve(
    histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS, share_of: float = SHARE
) -> list[tuple[int, list[int]]]:
    """Configurations as (number of sequences, lengths in one sequence) that hold all pieces.

    The work is bounded by `rounds` and `size`, not by the number of pieces.
    """
    plan = [(n, [size]) for length, n in histogram.items() if length == size and n]
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < size), np.int64)
    left = np.array([histogram[x] for x in lengths], np.int64)
    if not len(lengths):
        return plan
    whole = left.copy()
    # Full configurations are worth about 1 at these prices, with a little more for long pieces.
    prices = lengths / size * (1 + BONUS * lengths / size)
    for _ in range(rounds):
        open_ = np.flatnonzero(left)
        if not len(open_):
            break
        taken = np.zeros(len(lengths), np.int64)
        taken[open_] = _fullest(prices[open_], lengths[open_], size)
        used = np.flatnonzero(taken)
        taken[used] = np.minimum(taken[used], left[used])
        share = np.maximum(np.ceil(whole[used] * share_of), 1)
        times = int(max(1, (np.minimum(left[used], share) / taken[used]).min()))
        if size - int(taken @ lengths) > size // 64:
            break  # no configuration is nearly full any more: the rest goes best fit
        left[used] -= taken[used] * times
        prices[used] *= np.exp(-taken[used] * times / whole[used])
        plan.append((times, np.repeat(lengths, taken).tolist()))
    return plan + best_fit({int(x): int(n) for x, n in zip(lengths, left, strict=True) if n}, size)


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Longest first, each into the fullest sequence with room; equal sequences as one group."""
    groups: list[tuple[int, int, list[int]]] = []  # room, number of sequences, lengths
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            fitting = [g for g in range(len(groups)) if groups[g][0] >= length]
            if fitting:
                at = min(fitting, key=lambda g: groups[g][0])
                room, number, inside = groups.pop(at)
            else:
                room, number, inside = size, n, []
                number = max(1, n // (size // length))
            copies = min(room // length, n)
            used = min(number, n // copies)
            groups.append((room - copies * length, used, inside + [length] * copies))
            if number > used and inside:
                groups.append((room, number - used, inside))
            n -= used * copies
    return [(number, inside) for _, number, inside in groups]


def pack(
    docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces with sequence_id and offset; sequences are gapless from 0 and at most `size` long.

    Only the histogram (at most `size` numbers) and the plan made from it pass the
    driver. Repeated rows are packed as often as they come; no rows give none.
    """
    cut = stage(pieces(docs, vocabulary, size, end_id, with_ids), "pieces")
    counts = stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(solve(histogram, size))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    ranked = cut.join(starts, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def place(batch: pa.RecordBatch) -> dict:
        rank = batch.column("rank").to_numpy()
        key = batch.column("length").to_numpy().astype(np.int64) << 48 | rank
        at = np.searchsorted(slots["key"], key, "right") - 1
        first = slots["key"][at] & ((1 << 48) - 1)
        return {c: batch.column(c) for c in columns} | {
            "sequence_id": slots["sequence"][at] + rank - first,
            "offset": slots["offset"][at],
        }

    schema = (
        "doc_id long, piece int, start long, length int, ids_crc32 long"
        + ", ids binary" * with_ids
        + ", sequence_id long, offset long"
    )
    return map_rows(ranked, place, schema).withColumn("length", F.col("length").cast("long"))


def _slots(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length the first rank, first sequence and offset of every run of pieces."""
    rank, sequence, rows = {}, 0, []
    for times, inside in plan:
        offset = 0
        for length in inside:
            rows.append((length << 48 | rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        sequence += times
    made = np.array(sorted(rows) or [(0, 0, 0)], np.int64)
    return {"key": made[:, 0], "sequence": made[:, 1], "offset": made[:, 2]}
