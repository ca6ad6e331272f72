"""Hard negatives of anchors by slot-decomposed selection.

A positive's window reaches from a share of its score up to the score itself, so the
windows of one anchor overlap, while their upper limits split all scores into disjoint
slots. Every task that meets a part of the rows keeps, for each anchor and slot, the
k best rows of another label; these short lists are combined per slot. A window's k
best rows lie in the slots from its upper limit downwards, so one pass over an
anchor's slots, from the lowest up, carries the k best of each suffix and answers all
windows. Anchors in blocks meet rows in splits, both of bounded size; positives are
looked for among the rows of the anchor's label only, in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens.llm.tables import map_rows, stage
from ctxlens.runtime import broadcast_if_small

POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80
ANCHOR_BLOCK = 16384
SPLIT = 16384
TILE = 128
_MOST = 2**63 - 1

FOUND = "anchor long, slot int, id long, score long"
MINED = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def lower_limit(score: int, percent: int = LEAST_PERCENT) -> int:
    """The least whole number of which a hundred times is at least `percent` times the score."""
    return -((-percent * score) // 100)


def _matrix(vectors: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows; beyond 64 bits they stop at the greatest or least value."""
    most = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (a, b)]
    bound = a.shape[1] * most[0] * most[1]
    if bound < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if bound <= _MOST:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """Places among `some` of the k greatest scores, ties to the smaller id."""
    if len(some) > k:
        least = np.partition(score[some], len(some) - k)[len(some) - k]
        some = some[score[some] >= least]
    return some[np.lexsort((ids[some], -score[some]))][:k]


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    both = pa.chunked_array([*left.chunks, *right.chunks], left.type).combine_chunks()
    codes = both.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[: len(left)], codes[len(left) :]


def _select(k: int, same_label: bool):
    """Task of one block of anchors and one split of rows: the k best of each anchor and slot."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            ids = rows["id"].to_numpy()
            have = _matrix(rows["v"], rows.num_rows)
            want = _matrix(anchors["v"], anchors.num_rows)
            asked, own = anchors["anchor"].to_pylist(), anchors["id"].to_pylist()
            if not same_label:
                mine, theirs = _codes(anchors["label"], rows["label"])
                limits, lowest = anchors["limits"].to_pylist(), anchors["lowest"].to_pylist()
            for at in range(0, len(want), TILE):
                for i, score in enumerate(products(want[at : at + TILE], have), at):
                    if same_label:
                        cuts = ((0, np.flatnonzero(ids != own[i])),)
                    else:
                        some = np.flatnonzero(
                            (score <= limits[i][-1]) & (score >= lowest[i]) & (theirs != mine[i]) & (ids != own[i])
                        )
                        slots = np.searchsorted(np.array(limits[i]), score[some].astype(np.int64))
                        cuts = [(s, some[slots == s]) for s in np.unique(slots).tolist()]
                    for slot, some in cuts:
                        best = _best(score, ids, some, k)
                        out[0].append(np.full(len(best), asked[i]))
                        out[1].append(np.full(len(best), slot, np.int32))
                        out[2].append(ids[best])
                        out[3].append(score[best].astype(np.int64))
        types = (np.int64, np.int32, np.int64, np.int64)
        columns = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, types, strict=True)]
        return pa.table(columns, names=["anchor", "slot", "id", "score"])

    return run


def _dealt(anchors: DataFrame, rows: DataFrame, keys: list[str], k: int, same_label: bool) -> DataFrame:
    """The k best rows of each anchor and slot, over all blocks of anchors and splits of rows."""
    asked = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / ANCHOR_BLOCK).cast("int").alias("blocks"))
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("splits"))
    # Written, so that Spark can split the joins where a label is hot.
    sizes = broadcast_if_small(stage(asked.join(sizes, keys), "sizes"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = anchors.join(sizes, keys).withColumns(
        {"block": F.pmod(F.xxhash64("anchor"), "blocks").cast("int"), "split": spread("splits")}
    ).drop("blocks", "splits")
    right = rows.join(sizes, keys).withColumns(
        {"split": F.pmod(F.xxhash64("id", "v"), "splits").cast("int"), "block": spread("blocks")}
    ).drop("blocks", "splits")
    cell = [*keys, "block", "split"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_select(k, same_label), FOUND)
    rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _answers(k: int, percent: int):
    """Windows of each anchor from its slots' lists, by merging the slots from the lowest up."""

    def run(batch):
        out = {c.split()[0]: [] for c in MINED.split(", ")}
        columns = (batch.column(c).to_pylist() for c in ("id", "positives", "limits", "found"))
        for anchor, positives, limits, found in zip(*columns, strict=True):
            slots = {}
            for row in found:
                slots.setdefault(row["slot"], []).append((-row["score"], row["id"]))
            best, upto = [], {}
            for slot, limit in enumerate(limits):  # limits rise, and so do the slots' scores
                best = (sorted(slots.get(slot, [])) + best)[:k]
                upto[limit] = best
            for p in positives:
                least = lower_limit(p["score"], percent)
                for rank, (score, number) in enumerate(upto.get(p["score"], []), 1):
                    if -score < least:
                        break
                    for name, value in zip(
                        out, (anchor, p["id"], rank, number, p["score"], -score), strict=True
                    ):
                        out[name].append(value)
        return out

    return run


def _limits(percent: int):
    """Adds the upper limits of the windows that can hold a score, rising, and their least lower limit."""

    def run(batch):
        scores = [[p["score"] for p in ps] for ps in batch.column("positives").to_pylist()]
        open_ = [sorted({s for s in some if lower_limit(s, percent) <= s}) for some in scores]
        lowest = [min((lower_limit(s, percent) for s in some), default=None) for some in open_]
        return {"anchor": batch.column("anchor"), "positives": batch.column("positives"), "limits": open_, "lowest": lowest}

    return run


def positives_of(data: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """anchor, slot (0), id, score and rank of each anchor's k best other rows of its label."""
    return _dealt(anchors, data, ["dim", "label"], k, same_label=True)


def hard_negatives(
    data: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = LEAST_PERCENT,
) -> DataFrame:
    """For each anchor and each of its best positives, the best rows of another label in its window.

    Both tables have id, label and v (array<long>). A row's score is its inner product
    with the anchor; higher scores come first, ties by smaller id. The positives of an
    anchor are its first rows of the same label, the negatives of a positive the first
    rows of another label with a score between `percent` per cent of the positive's and
    the positive's own, ranked from 1. Rows with a null id, label or vector take no
    part; equal rows count once, rows that share an id only are rows of their own. An
    anchor's id is never its own positive or negative; only vectors of one length are
    compared, empty ones with score 0. A negative score opens no window. Anchors
    without positives or negatives, and empty tables, give no rows. Scores are exact up to
    64 bits and stop there. Other columns are ignored.
    """
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    columns = ["id", "label", "v", F.size("v").alias("dim")]
    data = stage(data.where(valid).select(*columns).distinct(), "vectors")
    # Numbered once and written, so the numbers stay whatever is run again.
    anchors = stage(
        anchors.where(valid).select(*columns).distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors"
    )
    near = positives_of(data, anchors, positives)
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    bounded = map_rows(
        near, _limits(percent),
        "anchor long, positives array<struct<rank: int, id: long, score: long>>, limits array<long>, lowest long",
    )
    asked = stage(anchors.join(bounded.where(F.col("lowest").isNotNull()), "anchor"), "asked")
    found = _dealt(asked.drop("positives"), data, ["dim"], negatives, same_label=False)
    found = found.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "id")).alias("found"))
    whole = asked.select("anchor", "id", "positives", "limits").join(found, "anchor")
    return map_rows(whole.drop("anchor"), _answers(negatives, percent), MINED)
