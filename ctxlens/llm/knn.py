"""Exact top-k search by inner product as a Voronoi join.

Pivots split the vectors into cells. A cell is known by its size, the radius around
its pivot and its longest vector, so it bounds the scores of any query in it from
both sides. From these summaries each query takes a score that at least k vectors
must reach, and asks only cells whose upper bound reaches it. Queries of neighbouring
cells form blocks; a cell's vectors go only to blocks that asked for the cell, in
splits of bounded size, and are solved there. Bounds are widened by a rounding
margin, so nothing that could be in an answer is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens.llm.tables import map_rows, stage
from ctxlens.llm.words import mix

NEAREST = 5
QUERY_BLOCK = 4096
SPLIT = 8192
MOST_PIVOTS = 256


def quantized(vector: Column, factor: int = 256) -> Column:
    """floor(factor * component), or null where a vector takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors])


def _assigned(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds dim, cell (nearest pivot of the same length, -1 without), distance and norm."""

    def run(batch):
        vectors = batch.column("v").to_pylist()
        cells, far, norms = [], [], []
        for v in vectors:
            x = np.asarray(v, np.float64)
            known = pivots.get(len(x))
            norms.append(float(np.sqrt(x @ x)))
            if known is None:
                cells.append(-1)
                far.append(norms[-1])
                continue
            gaps = np.sqrt(((known - x) ** 2).sum(axis=1))
            cells.append(int(gaps.argmin()))
            far.append(float(gaps.min()))
        return {"id": batch.column("id"), "v": vectors, "dim": [len(v) for v in vectors],
                "cell": cells, "far": far, "norm": norms}

    return map_rows(
        rows.select("id", "v"), run,
        "id long, v array<long>, dim int, cell int, far double, norm double",
    )


def nearest(data: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k greatest inner products.

    Both tables have id and v (array<long>). A row with the query's own id is no
    candidate; ties go to the smaller id; only vectors of one length are compared.
    Rows with a null id or vector take no part, repeated rows count once. A query
    without candidates has no rows. Scores are exact up to 2**53.
    """
    valid = F.col("id").isNotNull() & F.col("v").isNotNull()
    queries = queries.where(valid).select("id", "v").distinct()
    # Of equal vectors only the k + 1 smallest ids can be in an answer.
    order = F.row_number().over(W.partitionBy("v").orderBy("id"))
    data = data.where(valid).select("id", "v").distinct().withColumn("_r", order).where(F.col("_r") <= k + 1)
    data = stage(data.drop("_r"), "vectors")
    n = data.count()
    count = max(8, min(MOST_PIVOTS, n // (SPLIT // 2)))
    chosen = data.orderBy(F.xxhash64("id"), "id").limit(count).collect()  # at most MOST_PIVOTS vectors
    pivots = {d: _matrix([r.v for r in chosen if len(r.v) == d]) for d in {len(r.v) for r in chosen}}
    data = stage(_assigned(data, pivots), "cells")
    summary = data.groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")
    )
    asked = stage(_assigned(queries, pivots), "queries")
    # One row per pivot and vector length; lengths without a pivot share the cell -1 of their length.
    cells = summary.where(F.col("cell") >= 0).toPandas()
    blocks = _blocks(asked.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect())
    routed = stage(_routed(asked, pivots, cells, blocks, k), "routes")
    wanted = routed.select("dim", "block", F.explode("cells").alias("cell")).distinct()
    splits = summary.select("dim", "cell", F.ceil(F.col("n") / SPLIT).cast("int").alias("splits"))
    wanted = wanted.join(splits, ["dim", "cell"])
    left = data.join(wanted, ["dim", "cell"]).select(
        "dim", "block", "cell", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int").alias("split"),
        F.lit(False).alias("ask"), "id", "v",
    )
    right = (
        routed.select("dim", "block", F.explode("cells").alias("cell"), "id", "v")
        .join(splits, ["dim", "cell"])
        .select(
            "dim", "block", "cell", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"),
            F.lit(True).alias("ask"), "id", "v",
        )
    )

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        have, want = part[~part.ask.astype(bool)].sort_values("id"), part[part.ask.astype(bool)]
        ids = have.id.to_numpy(np.int64)
        out = []
        if len(have) and len(want):
            x = _matrix(have.v)
            for at in range(0, len(want), 256):
                some = want.iloc[at : at + 256]
                for q, score in zip(some.id, _matrix(some.v) @ x.T, strict=True):
                    score[ids == q] = -np.inf
                    kept = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
                    best = kept[np.lexsort((ids[kept], -score[kept]))][:k]
                    out += [(q, i, s) for i, s in zip(ids[best], score[best], strict=True) if s > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    local = left.union(right).groupBy("dim", "block", "cell", "split").applyInPandas(
        solve, "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (
        local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _blocks(counts) -> dict[tuple[int, int], tuple[int, int]]:
    """First block and number of blocks of each query cell; small neighbours share a block."""
    out, block, room = {}, -1, 0
    for dim, cell, n in sorted((r.dim, r.cell, r.n) for r in counts):
        if n > room or (out and next(reversed(out))[0] != dim):
            block, room = block + 1, QUERY_BLOCK
        number = -(-n // QUERY_BLOCK)
        out[dim, cell] = (block, number)
        block, room = block + number - 1, max(0, room - n) if number == 1 else 0
    return out


def _routed(asked: DataFrame, pivots, cells: pd.DataFrame, blocks, k: int) -> DataFrame:
    """Adds each query's block and the cells that can hold one of its k best."""
    by_dim = {d: g for d, g in cells.groupby("dim")}

    def run(batch):
        vectors, out, at = batch.column("v").to_pylist(), [], []
        # By a hash: the ids of queries may share any divisor.
        dealt = mix(batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64)).tolist()
        for number, v, cell in zip(dealt, vectors, batch.column("cell").to_pylist(), strict=True):
            x = np.asarray(v, np.float64)
            first, many = blocks[len(x), cell]
            at.append(first + number % many)
            known = by_dim.get(len(x))
            if cell < 0 or known is None:
                out.append([-1])
                continue
            norm = np.sqrt(x @ x)
            middle = pivots[len(x)][known.cell] @ x
            slack = norm * known.radius.to_numpy() * (1 + 1e-9) + 1e-6 * (1 + abs(middle))
            low = middle - slack
            high = np.minimum(middle + slack, norm * known.norm.to_numpy() * (1 + 1e-9) + 1e-6)
            order = np.argsort(-low)
            # The query itself may be in a cell, so k + 1 vectors are counted.
            enough = np.searchsorted(np.cumsum(known.n.to_numpy()[order]), k + 1)
            reach = low[order[enough]] if enough < len(order) else -np.inf
            out.append(known.cell.to_numpy()[high >= reach].tolist())
        return {"id": batch.column("id"), "v": vectors, "dim": batch.column("dim"), "block": at, "cells": out}

    return map_rows(asked, run, "id long, v array<long>, dim int, block int, cells array<int>")
