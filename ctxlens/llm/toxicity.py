"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Fitting uses a bounded sample of labelled rows (`examples` of each class); inverse
document frequencies are counted over all documents. Terms are words and beginnings
of words, as such and as seen at least twice or four times; those whose share differs
between the sampled classes beyond chance are used. The examples stand in an inverted
index in blocks with each term's greatest weight per block; a block is scored only if
its upper bound can still reach the nearest k, so the k found are exact. Votes are
weighted by similarity and by how many rows an example stands for, and calibrated on
the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.llm.tables import bytes_of, map_rows, row_key, stage
from ctxlens.llm.words import plain_words

EXAMPLES = 2000
TERMS = 4096
LEAST_Z = 5.0
LEAST_SUPPORT = 3
NEAREST = 15
BLOCK = 64
PRIOR_WEIGHT = 0.05
BEGINNINGS = (3, 4, 5, 6, 7)
LEVELS = (1, 2, 4)
MAX_CACHED = 300_000
REJECT_AT = 0.3


def held_out():
    """Rows that labels are never learned from: crc32 of the number as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms_of(word: bytes) -> list[bytes]:
    """The word and its beginnings, marked by a star."""
    return [word] + [word[:n] + b"*" for n in BEGINNINGS if len(word) >= n]


def leveled(counts: dict) -> dict:
    """(term, level) and how often it is there; higher levels are there or not."""
    out = {}
    for term, n in counts.items():
        for level in LEVELS:
            if n >= level:
                out[term, level] = n if level == 1 else 1
    return out


class Known(dict):
    """Of each word seen lately, the terms that the vocabulary has at any level."""

    def __init__(self, vocabulary: dict[tuple[bytes, int], int]) -> None:
        super().__init__()
        self.terms = {term for term, _ in vocabulary}

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= MAX_CACHED:
            self.clear()
        found = self[word] = tuple(t for t in terms_of(word) if t in self.terms)
        return found

    def counts(self, words: list[bytes]) -> Counter:
        held = Counter()
        for word, n in Counter(words).items():
            for term in self[word]:
                held[term] += n
        return held


@dataclass
class Index:
    """Examples in blocks, postings by term and block, and the calibration."""

    vocabulary: dict[tuple[bytes, int], int]
    idf: np.ndarray
    ids: np.ndarray
    vote: np.ndarray
    weight: np.ndarray
    begin: np.ndarray  # terms x blocks + 1, into the postings
    place: np.ndarray
    value: np.ndarray
    bound: np.ndarray  # terms x blocks, greatest weight
    prior: float = 0.0
    knots: tuple = ((0.0, 1.0), (0.0, 1.0))
    known: Known | None = None

    def counts(self, words: list[bytes]) -> dict[int, int]:
        """Known terms of a text and how often they are there."""
        if self.known is None:
            self.known = Known(self.vocabulary)
        found = leveled(self.known.counts(words))
        return {self.vocabulary[t]: n for t, n in found.items() if t in self.vocabulary}

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts(words)
        terms = np.fromiter(sorted(counts), np.int64, len(counts))
        tf = np.fromiter((counts[t] for t in terms.tolist()), np.float64, len(counts))
        return terms, unit((1 + np.log(tf)) * self.idf[terms]) if len(terms) else tf

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST, without: int = -1):
        """The k examples of greatest cosine above zero, ties to the earlier one."""
        if not len(terms) or not len(self.ids):
            return np.empty(0, np.int64), np.empty(0)
        bounds = weights @ self.bound[terms]
        found, scores, reach = [np.empty(0, np.int64)], [np.empty(0)], 0.0
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 0 or bounds[b] < reach - 1e-9:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                s, e = self.begin[t, b], self.begin[t, b + 1]
                score[self.place[s:e]] += w * self.value[s:e]
            if without // BLOCK == b:
                score[without % BLOCK] = 0
            near = np.flatnonzero(score > max(0.0, reach - 1e-9))
            found.append(near + b * BLOCK)
            scores.append(score[near])
            if len(near):
                every, at = np.concatenate(scores), np.concatenate(found)
                best = np.lexsort((at, -every))[:k]
                found, scores = [at[best]], [every[best]]
                if len(best) == k:
                    reach = every[best[-1]]
        return np.concatenate(found), np.concatenate(scores)

    def raw(self, near: np.ndarray, scores: np.ndarray) -> float:
        shares = self.weight[near] * scores
        total = shares.sum() + PRIOR_WEIGHT
        return float((shares @ self.vote[near] + PRIOR_WEIGHT * self.prior) / total)

    def calibrated(self, raw):
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * raw


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means of y that do not fall as x rises, at the distinct x (pool adjacent violators)."""
    pools: list[list[float]] = []  # weight, weighted sum, first x, last x
    for v in np.unique(x):
        at = x == v
        pools.append([w[at].sum(), (w[at] * y[at]).sum(), v, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0] + b[0], a[1] + b[1], a[2], b[3]])
    xs, ys = [], []
    for weight, total, first, last in pools:
        for v in dict.fromkeys((first, last)):
            xs.append(v)
            ys.append(total / weight)
    return np.array(xs), np.array(ys)


def _sample(docs: DataFrame, labels: DataFrame, examples: int) -> tuple[DataFrame, dict[int, int]]:
    """Up to `examples` rows of each class with their class sizes; the order is by a hash."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    parts = [known.where(F.col("toxic") == c).orderBy(*order).limit(examples) for c in (0, 1)]
    return parts[0].union(parts[1]), sizes


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Index:
    """The index over a sample of labelled documents; without labels of both kinds it knows no terms."""
    chosen, sizes = _sample(docs, labels, examples)
    # At most 2 * examples rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    # Equal texts are one example; a text labelled both ways counts as toxic.
    texts = stage(
        texts.groupBy(row_key().alias("key"))
        .agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text")),
        "examples",
    )
    n = dict.fromkeys((0, 1), 0) | {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if not n[0] or not n[1]:
        return _index({}, np.empty(0), [], np.ones(2), base)

    def spread(batch):
        out = {c: [] for c in ("term", "level", "toxic")}
        for toxic, text in zip(batch.column("toxic").to_pylist(), bytes_of(batch, "text"), strict=True):
            counts = Counter()
            for word, times in Counter(plain_words(text)).items():
                for term in terms_of(word):
                    counts[term] += times
            for term, level in leveled(counts):
                out["term"].append(term)
                out["level"].append(level)
                out["toxic"].append(toxic)
        return out

    share = (F.col("pos") + F.col("neg")) / float(n[0] + n[1])
    z = (F.col("pos") / float(n[1]) - F.col("neg") / float(n[0])) / F.sqrt(
        share * (1 - share) * float(1 / n[0] + 1 / n[1]) + 1e-12
    )
    picked = (
        map_rows(texts, spread, "term binary, level int, toxic int")
        .groupBy("term", "level")
        .agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
        .where((F.col("pos") + F.col("neg") >= LEAST_SUPPORT) & (F.abs(z) >= LEAST_Z))
        .orderBy(F.abs(z).desc(), "term", "level")
        .limit(terms)
    )
    vocabulary = {(bytes(r.term), r.level): i for i, r in enumerate(picked.select("term", "level").collect())}
    known = Known(vocabulary)

    def counts_of(batch):
        found = [
            {vocabulary[t]: n for t, n in leveled(known.counts(plain_words(x))).items() if t in vocabulary}
            for x in bytes_of(batch, "text")
        ]
        return {"key": batch.column("key"), "doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"),
                "terms": [list(f) for f in found], "tf": [list(f.values()) for f in found]}

    rows = map_rows(
        texts, counts_of, "key long, doc_id long, toxic int, terms array<int>, tf array<long>"
    ).orderBy("key").collect()
    vectors = [(r.doc_id, r.toxic, sorted(zip(r.terms, r.tf, strict=True))) for r in rows]
    weight = np.array([sizes.get(c, 0) / n[c] for c in (0, 1)])
    return _index(vocabulary, _idf(docs, vocabulary), vectors, weight, base)


def _idf(docs: DataFrame, vocabulary: dict[tuple[bytes, int], int]) -> np.ndarray:
    """From document frequencies over all documents; the result has one number per term."""
    known = Known(vocabulary)

    def count(batch):
        held = Counter()
        texts = bytes_of(batch, "text")
        for text in texts:
            found = leveled(known.counts(plain_words(text)))
            held.update(vocabulary[t] for t in found if t in vocabulary)
        return {"term": [-1, *held], "n": [len(texts), *held.values()]}

    counted = map_rows(docs.select("text"), count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    numbers = {r.term: r.n for r in counted.collect()}
    df = np.array([numbers.get(i, 0) for i in range(len(vocabulary))], float)
    return np.log(1 + numbers.get(-1, 0) / (1 + df))


def _index(vocabulary, idf, examples, weight, base) -> Index:
    """Lay the examples out in blocks of like ones and calibrate."""
    vectors = []
    for number, toxic, pairs in examples:
        t = np.array([i for i, _ in pairs], np.int64)
        tf = np.array([c for _, c in pairs], float)
        vectors.append((number, toxic, t, unit((1 + np.log(tf)) * idf[t]) if len(t) else tf))
    held = [v for v in vectors if len(v[2])]
    held.sort(key=lambda v: (v[2][v[3].argmax()], v[1], v[0]))
    blocks = -(-len(held) // BLOCK)
    shape = (len(vocabulary), blocks)
    rows = np.repeat(np.arange(len(held)), [len(v[2]) for v in held]) if held else np.empty(0, np.int64)
    term = np.concatenate([v[2] for v in held]) if held else np.empty(0, np.int64)
    value = np.concatenate([v[3] for v in held]) if held else np.empty(0)
    order = np.lexsort((rows, term))
    rows, term, value = rows[order], term[order], value[order]
    cell = term * max(1, blocks) + rows // BLOCK
    edges = np.searchsorted(cell, np.arange(shape[0] * shape[1] + 1))
    begin = (
        np.column_stack((edges[:-1].reshape(shape), edges[1:].reshape(shape)[:, -1]))
        if held else np.zeros((shape[0], 1), np.int64)
    )
    bound = np.zeros(shape)
    np.maximum.at(bound, (term, rows // BLOCK), value)
    made = Index(
        vocabulary, idf, np.array([v[0] for v in held], np.int64), np.array([v[1] for v in held], float),
        np.array([weight[v[1]] for v in held]), begin, rows % BLOCK, value, bound,
    )
    bare = [v[1] for v in vectors if not len(v[2])]
    mass = sum(weight[y] for y in bare)
    made.prior = sum(weight[y] * y for y in bare) / mass if mass else base
    if not held:
        made.knots = ((0.0, 1.0), (made.prior, made.prior))
        return made
    raw = np.array([made.raw(*made.nearest(v[2], v[3], without=i)) for i, v in enumerate(held)] + [made.prior] * len(bare))
    y = np.array([v[1] for v in held] + bare, float)
    made.knots = _isotonic(raw, y, weight[y.astype(int)])
    return made


def _scored(index: Index, texts: list[bytes | None]):
    for text in texts:
        near, scores = index.nearest(*index.vector(plain_words(text)))
        yield float(index.calibrated(index.raw(near, scores))), near, scores


def scores(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples) of every document.

    Null and empty texts, and texts without any known term, get the calibrated share of
    toxic rows among examples without known terms. A null doc_id is not held out.
    Labels other than 0 and 1 are left aside; a number labelled both ways counts as
    toxic. Without examples of both kinds every score is the share of toxic labels.
    Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **sizes))

    def run(batch):
        index, values, evidence = shared.value, [], []
        for score, near, cosines in _scored(index, bytes_of(batch, "text")):
            values.append(score)
            evidence.append(
                [{"doc_id": int(index.ids[i]), "toxic": int(index.vote[i]), "cosine": float(c)}
                 for i, c in zip(near[:3], cosines[:3], strict=True)]
            )
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": values,
                "predicted": [int(v >= REJECT_AT) for v in values], "evidence": evidence}

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", held_out())
    return map_rows(
        rows, run,
        "doc_id long, held_out boolean, score double, predicted int, "
        "evidence array<struct<doc_id: long, toxic: int, cosine: double>>",
    )


def accepted(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """`docs` without the rows whose score reaches the limit, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **sizes))

    def run(batches):
        for batch in batches:
            keep = [s < REJECT_AT for s, _, _ in _scored(shared.value, bytes_of(batch, "text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
