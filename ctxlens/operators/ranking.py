"""Relevance, recency and the combined ranking of files for a query."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.functions.once import once_if
from ctxlens.functions.text import base_name, file_key, file_summary, query_words
from ctxlens.operators.imports import neighbourhood

QUERIES_PER_SCAN = 64


@dataclass(frozen=True)
class Query:
    """A question to rank files for; `target` is a path in the corpus, if known."""

    query_id: int
    text: str
    target: str | None = None


@dataclass(frozen=True)
class FileSets:
    """Files of questions as sets, where rows of pairs would be too many.

    `rows` (query_id, file_key, part, files, places): a row without file_key has a bit for each file key of
    a part, `files` of them set; one with a file_key is that key, which several parts hold, once for each.
    `keys` (file_key, part, place) tells the place of a bit. All files score at least `threshold`.
    """

    rows: DataFrame
    keys: DataFrame
    threshold: float


# --- recency -----------------------------------------------------------------------


def last_edits(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", "path").agg(F.max("commit_ts").alias("last_edit"))


def decay(age_days: Column, half_life_days: float = fv.HALF_LIFE_DAYS) -> Column:
    return F.exp(F.lit(-math.log(2.0) / half_life_days) * F.greatest(F.lit(0.0), age_days))


def recency(
    commits: DataFrame, as_of: datetime | str, half_life_days: float = fv.HALF_LIFE_DAYS
) -> DataFrame:
    """recency(repo, path, score): 1 for an edit at `as_of`, halved every half-life."""
    now = F.unix_micros(F.lit(str(as_of)).cast("timestamp"))
    age = (now - F.unix_micros(F.col("last_edit").cast("timestamp"))) / F.lit(86_400e6)
    return last_edits(commits).select(
        "repo", "path", decay(age, half_life_days).alias("score")
    )


# --- relevance ---------------------------------------------------------------------


def summaries(
    code_files: DataFrame, max_chars: int | None = None, max_lines: int | None = None
) -> DataFrame:
    """(repo, path, summary) of whole files or, with limits, of their beginnings.

    Files with an empty summary are left out.
    """
    summary = once_if(file_summary(F.col("content"), max_chars, max_lines), lambda s: s != "")
    return code_files.select("repo", "path", summary.alias("summary"))


def keyword_score(haystack: Column, words: Column) -> Column:
    """Share of the words that occur in the text, as substrings."""
    found = F.size(F.filter(words, lambda w: F.contains(haystack, w)))
    return F.when(F.size(words) > 0, found / F.size(words))


def haystack(path: Column, summary: Column) -> Column:
    return F.lower(F.concat(base_name(path), F.lit(" "), summary))


def keyword_scores(summary_rows: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(query_id, repo, path, score) of every file for every query with words.

    Queries are parameters and enter the scan as literals, a bounded number at a
    time; more queries mean more scans. No table of pairs is shuffled or joined.
    """
    out = None
    for lo in range(0, len(queries), QUERIES_PER_SCAN):
        group = queries[lo : lo + QUERIES_PER_SCAN]
        literal = F.array(
            *[
                F.struct(
                    F.lit(q.query_id).cast("bigint").alias("query_id"),
                    query_words(F.lit(q.text)).alias("words"),
                )
                for q in group
            ]
        )
        rows = (
            summary_rows.withColumn("_hay", haystack(F.col("path"), F.col("summary")))
            .select("repo", "path", "_hay", F.inline(literal))
            .where(F.size("words") > 0)
            .select(
                "query_id", "repo", "path",
                keyword_score(F.col("_hay"), F.col("words")).alias("score"),
            )
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no queries given")
    return out


def _cosine(vectors: pa.Array, query: pa.Array) -> pa.Array:
    """Cosine of each vector with the query vector of its row, in double; null for null."""

    def matrix(a: pa.Array) -> np.ndarray:
        flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(a), -1)

    good = vectors.is_valid()
    known = good.to_numpy(zero_copy_only=False)
    out = np.zeros(len(known))
    if known.any():
        left, right = matrix(vectors.filter(good)), matrix(query.filter(good))
        norm = np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1))
        dot = (left * right).sum(axis=1)
        out[known] = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
    return pa.array(out, mask=~known)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length, JVM-side; 0 for a zero vector."""
    zero = F.lit(0.0)

    def total(x: Column) -> Column:
        return F.aggregate(x, zero, lambda acc, v: acc + v)

    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(
        total(F.transform(y, lambda p: p * p))
    )
    return F.when(norm == 0, zero).otherwise(dot / norm)


def cosine_scores(vectors: DataFrame, query_vector: Column, size: int | None = None) -> DataFrame:
    """(path, score) of every vector for one query vector, negatives clipped to 0.

    `query_vector` is a literal or a scalar subquery. With `size`, vectors are
    compared in Arrow batches. Either way a vector that is null, holds a null or has
    another length than the query is kept with a null score.
    """
    vectors = vectors.withColumn("_query", query_vector)
    if size is None:
        score = cosine(F.col("embedding"), F.col("_query"))
    else:
        both = _whole(F.col("embedding"), size) & _whole(F.col("_query"), size)
        score = F.arrow_udf(_cosine, "double")(F.when(both, F.col("embedding")), F.col("_query"))
    vectors = vectors.withColumn("score", score)
    clipped = F.when(F.col("score").isNotNull(), F.greatest(F.lit(0.0), F.col("score")))
    return vectors.select("path", clipped.alias("score"))


def _whole(vector: Column, size: int) -> Column:
    """Has `size` values, none of them null."""
    return (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull())


def boosted_files(
    scores: DataFrame | FileSets, threshold: float = fv.BOOST_THRESHOLD
) -> DataFrame | FileSets:
    """Files relevant enough to count as active: (query_id, file_key), or sets of them as they are."""
    if isinstance(scores, FileSets):
        if scores.threshold != threshold:
            raise ValueError("sets hold the files above their own threshold")
        return scores
    return (
        scores.where(F.col("score") >= threshold)
        .select("query_id", file_key(F.col("path")).alias("file_key"))
        .distinct()
    )


def top_k(scores: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Best `k` by score, ties by path; per `by` if given."""
    order = [F.col("score").desc(), F.col("path").asc()]
    if "repo" in scores.columns:
        order.append(F.col("repo").asc())
    if by is None:
        return scores.orderBy(*order).limit(k)
    ranked = scores.withColumn("rank_no", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank_no") <= k)


# --- fusion ------------------------------------------------------------------------


def best_guess(scores: DataFrame) -> DataFrame:
    """Most relevant file per query: a one-row-per-group limit, ties by path."""
    return top_k(scores, 1, "query_id").select(
        "query_id", "repo", F.col("path").alias("target")
    )


def structural_scores(targets: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """targets(query_id, repo, target) -> (query_id, repo, path, score).

    A file that is both a dependency and a dependent counts as a dependent.
    """
    starts = targets.select("repo", F.col("target").alias("start")).distinct()
    near = neighbourhood(starts, edge_rows, depth=1).select(
        "repo",
        F.col("start").alias("target"),
        F.col("node").alias("path"),
        F.when(F.col("relation") == "dependent", fv.DEPENDENT_SCORE)
        .otherwise(fv.DEPENDENCY_SCORE)
        .alias("score"),
    )
    around = (
        targets.join(near, ["repo", "target"])
        .groupBy("query_id", "repo", "path")
        .agg(F.min("score").alias("score"))
    )
    own = targets.select(
        "query_id", "repo", F.col("target").alias("path"), F.lit(fv.TARGET_SCORE).alias("score")
    )
    return own.unionByName(around)


def rank_files(
    relevance: DataFrame,
    structure: DataFrame,
    recency_rows: DataFrame,
    query_ids: Sequence[int],
    k: int = fv.RANK_TOP_K,
    weights: tuple[float, float, float] = fv.RANK_WEIGHTS,
) -> DataFrame:
    """Top `k` files per query by the weighted sum of the three signals.

    Files that neither relevance nor structure speaks for differ by recency only,
    so of those just the `k` most recent can enter a top `k`; with a recency weight of
    0 they differ by path only, and the `k` smallest paths can. Only they are paired
    with the queries; all others are scored from their own rows. This is exact
    because weights are not negative and ties are ordered by path everywhere.
    """
    if min(weights) < 0:
        raise ValueError("weights must not be negative")
    w_rel, w_str, w_rec = (F.lit(float(w)) for w in weights)
    keys = ["query_id", "repo", "path"]
    spoken = (
        relevance.where(F.col("score") > 0)
        .select(*keys, F.col("score").alias("semantic"))
        .join(structure.select(*keys, F.col("score").alias("structural")), keys, "full")
    )
    ids = F.array(*[F.lit(q).cast("bigint") for q in query_ids])
    unspoken = recency_rows if weights[2] > 0 else recency_rows.withColumn("score", F.lit(0.0))
    fresh = top_k(unspoken, k).select("repo", "path", F.explode(ids).alias("query_id"))
    candidates = spoken.unionByName(fresh, allowMissingColumns=True)
    silent = relevance.where(F.col("score") == 0).select(*keys)
    zero = top_k_by_path(silent, k)
    candidates = candidates.unionByName(zero, allowMissingColumns=True)
    merged = candidates.groupBy(*keys).agg(
        F.coalesce(F.max("semantic"), F.lit(0.0)).alias("semantic"),
        F.coalesce(F.max("structural"), F.lit(0.0)).alias("structural"),
    )
    scored = merged.join(
        recency_rows.select("repo", "path", F.col("score").alias("_temporal")),
        ["repo", "path"],
        "left",
    ).withColumn("temporal", F.coalesce("_temporal", F.lit(0.0)))
    total = w_rel * F.col("semantic") + w_str * F.col("structural") + w_rec * F.col("temporal")
    return top_k(scored.withColumn("score", total), k, "query_id").select(
        *keys, "semantic", "structural", "temporal", "score", "rank_no"
    )


def top_k_by_path(rows: DataFrame, k: int) -> DataFrame:
    """First `k` paths per query: all that can matter among files with no score at all."""
    order = W.partitionBy("query_id").orderBy("path", "repo")
    return (
        rows.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= k).drop("_no")
    )


def assemble_context(
    code_files: DataFrame,
    edge_rows: DataFrame,
    recency_rows: DataFrame,
    queries: Sequence[Query],
    k: int = fv.RANK_TOP_K,
    weights: tuple[float, float, float] = fv.RANK_WEIGHTS,
) -> DataFrame:
    """Rank a corpus for a batch of queries; without a target the best match is taken."""
    relevance = keyword_scores(summaries(code_files), queries)
    given = [(q.query_id, q.target) for q in queries if q.target is not None]
    spark = code_files.sparkSession
    guesses = best_guess(relevance)
    if given:
        named = spark.createDataFrame(given, "query_id bigint, target string")
        known = named.join(
            code_files.select("repo", F.col("path").alias("target")), "target"
        ).select("query_id", "repo", "target")
        ids = [q for q, _ in given]
        targets = guesses.where(~F.col("query_id").isin(ids)).unionByName(known)
    else:
        targets = guesses
    structure = structural_scores(targets, edge_rows)
    return rank_files(
        relevance, structure, recency_rows, [q.query_id for q in queries], k, weights
    )
