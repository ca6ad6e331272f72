"""Removal of long repeated spans by compaction of a token de Bruijn graph.

Every 50 consecutive words of a document are an edge of the graph (from its first 49
words to its last 49). Edges are dealt out by their minimizer, the least hash among
the 16-word runs inside: equal edges always meet there. Neighbouring edges of a
document with one minimizer are compacted into a path, so a path stands for about
18 words of text. Where all paths of a minimizer are equal the graph does not branch
and the path is decided as a whole; only where paths differ are single edges
compared. A decided path or edge names its first document (the source coordinate);
the words are the same if the hashes of 16 words and of the whole path or edge,
64 bits each and independent, agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.llm.tables import bytes_of, fresh, map_rows, row_key, stage
from ctxlens.llm.words import WordHashes, mix, run_hashes, sliding_min, spaced_words

WINDOW = 50
MINIMIZER = 16

_HASHES = WordHashes()


def paths(words: list[bytes], window: int, minimizer: int):
    """Minimizer, content hash, first edge and number of edges of each path; hash of each edge."""
    hashes = _HASHES.of(words)
    edges = run_hashes(hashes, window)
    if not len(edges):
        return edges, edges, np.empty(0, np.int64), np.empty(0, np.int64), edges
    least = sliding_min(run_hashes(hashes, minimizer), window - minimizer + 1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    counts = np.diff(np.append(starts, len(least)))
    place = np.arange(len(edges)) - np.repeat(starts, counts)
    content = mix(np.add.reduceat(mix(edges + mix(place.astype(np.uint64))), starts))
    return least[starts], content, starts, counts, edges


def _path_rows(docs: DataFrame, window: int, minimizer: int) -> DataFrame:
    """One row per path: m (minimizer), content, doc_id, key and place (first edge, edges)."""

    def run(batch):
        ms, contents, places, lengths = [], [], [], []
        for text in bytes_of(batch, "text"):
            m, content, starts, counts, _ = paths(spaced_words(text), window, minimizer)
            ms.append(m)
            contents.append(content)
            places.append(starts << 32 | counts)
            lengths.append(len(m))
        lengths = np.array(lengths)
        return {
            "m": np.concatenate(ms).view(np.int64),
            "content": np.concatenate(contents).view(np.int64),
            "doc_id": np.repeat(batch.column("doc_id").to_numpy(), lengths),
            "key": np.repeat(batch.column("key").to_numpy(), lengths),
            "place": np.concatenate(places),
        }

    return map_rows(docs, run, "m long, content long, doc_id long, key long, place long")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, for the joins by document that need them."""

    def run(batch):
        press = zstandard.ZstdCompressor(level=1)
        return {
            "doc_id": batch.column("doc_id"),
            "key": batch.column("key"),
            "packed": [None if t is None else press.compress(t) for t in bytes_of(batch, "text")],
        }

    return map_rows(docs, run, "doc_id long, key long, packed binary")


def unpacked(batch: pa.RecordBatch) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if t is None else press.decompress(t) for t in batch.column("packed").to_pylist()]


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER
) -> DataFrame:
    """doc_id, key and `spans`: word ranges [start, stop) that begin in a smaller doc_id too.

    `docs` has doc_id, key and text. Only documents with such words have a row.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    rows = _path_rows(named, window, minimizer)
    # Written tables on both sides of the joins let Spark split a hot minimizer or edge.
    shared = stage(
        rows.groupBy("m")
        .agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
            F.min("content").alias("low"), F.max("content").alias("high"),
        )
        .where(F.col("first") < F.col("last"))
        .select("m", "first", (F.col("low") != F.col("high")).alias("branches")),
        "shared",
    )
    met = stage(
        rows.select("m", "doc_id", "key", "place")
        .join(shared, "m")
        .where(F.col("branches") | (F.col("first") < F.col("doc_id")))
        .select(
            "doc_id", "key", "place", "branches",
        ),
        "paths",
    )
    start = F.shiftright("place", 32)
    whole = met.where(~F.col("branches")).select(
        "doc_id", "key", start.cast("int").alias("start"),
        (start + F.col("place").bitwiseAND(0xFFFFFFFF) + (window - 1)).cast("int").alias("stop"),
    )
    branching = (
        met.where("branches").groupBy("doc_id", "key").agg(F.collect_list("place").alias("places"))
    )
    edges = stage(_edge_rows(_packed(named).join(branching, ["doc_id", "key"]), window, minimizer), "edges")
    first = stage(
        edges.groupBy("m", "edge")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where(F.col("first") < F.col("last"))
        .select("m", "edge", "first"),
        "first",
    )
    single = (
        edges.join(first, ["m", "edge"])
        .where(F.col("first") < F.col("doc_id"))
        .select("doc_id", "key", "start", (F.col("start") + window).alias("stop"))
    )
    return (
        whole.union(single)
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )


def _edge_rows(docs: DataFrame, window: int, minimizer: int) -> DataFrame:
    """Single edges of the paths in `places`."""

    def run(batch):
        out = {c: [] for c in ("m", "edge", "start")}
        lengths = []
        for text, places in zip(unpacked(batch), batch.column("places"), strict=True):
            m, _, starts, counts, edges = paths(spaced_words(text), window, minimizer)
            wanted = np.isin(starts, places.values.to_numpy() >> 32)
            at = np.flatnonzero(np.repeat(wanted, counts))
            out["m"].append(np.repeat(m, counts)[at])
            out["edge"].append(edges[at])
            out["start"].append(at)
            lengths.append(len(at))
        lengths = np.array(lengths)
        return {
            "m": np.concatenate(out["m"]).view(np.int64),
            "edge": np.concatenate(out["edge"]).view(np.int64),
            "start": np.concatenate(out["start"]).astype(np.int32),
            "doc_id": np.repeat(batch.column("doc_id").to_numpy(), lengths),
            "key": np.repeat(batch.column("key").to_numpy(), lengths),
        }

    return map_rows(docs, run, "m long, edge long, start int, doc_id long, key long")


def kept_words(words: list[bytes], spans) -> list[bytes]:
    """Words outside the spans, given as (start, stop) arrays or None."""
    if spans is None:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, spans[0], 1)
    np.add.at(change, spans[1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _spans(batch: pa.RecordBatch) -> list:
    return [
        None if s.values is None
        else (s.values.field("start").to_numpy(), s.values.field("stop").to_numpy())
        for s in batch.column("spans")
    ]


def _with_spans(docs: DataFrame, window: int, minimizer: int) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("key"))
    found = repeated_spans(keyed, window, minimizer)
    return _packed(keyed).join(found, ["doc_id", "key"], "left")


def removed_repeats(
    docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    A word goes if a window over it also starts in a document with a smaller doc_id;
    windows are judged on the input. Texts with fewer words than a window, empty and
    null texts lose nothing. A null doc_id has no order and loses nothing. Repeated
    rows of one doc_id do not count against each other; no rows give none.
    """

    def run(batch):
        n, removed, digests = [], [], []
        for text, spans in zip(unpacked(batch), _spans(batch), strict=True):
            words = spaced_words(text)
            kept = kept_words(words, spans)
            n.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return {
            "doc_id": batch.column("doc_id"), "n_words": n, "n_removed": removed,
            "kept_sha256": digests,
        }

    return map_rows(
        _with_spans(docs, window, minimizer), run,
        "doc_id long, n_words long, n_removed long, kept_sha256 string",
    )


def without_repeats(
    docs: DataFrame, window: int = WINDOW, minimizer: int = MINIMIZER
) -> DataFrame:
    """`docs` with repeated spans cut out of the texts.

    A text that loses words holds the kept words joined by one space, any other text
    stays as it is; n_chars follows the text. Every document stays.
    """

    def run(batch):
        texts = [
            None if s is None else b" ".join(kept_words(spaced_words(t), s)).decode()
            for t, s in zip(unpacked(batch), _spans(batch), strict=True)
        ]
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "kept": texts}

    columns = docs.columns
    number, mine, other, kept = (fresh(docs, c) for c in ("_doc", "_mine", "_other", "_kept"))
    keyed = docs.withColumn(mine, row_key())
    plain = keyed.select(F.col("doc_id").cast("long"), "text", F.col(mine).alias("key"))
    found = repeated_spans(plain, window, minimizer)
    cut = map_rows(
        _packed(plain).join(found, ["doc_id", "key"]), run, "doc_id long, key long, kept string"
    ).dropDuplicates(["doc_id", "key"])
    joined = keyed.join(
        cut.toDF(number, other, kept),
        (F.col("doc_id") == F.col(number)) & (F.col(mine) == F.col(other)), "left",
    )
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(
            F.char_length(kept).cast(docs.schema["n_chars"].dataType)
        )
    return joined.withColumns(new).select(*columns)
