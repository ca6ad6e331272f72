"""Benchmark decontamination: prefix-filtered set join with exact verification.

An item is cut into windows of ten consecutive words; a window is a set of shingles of
five words (one shingle of all its words, if it has fewer). A window counts only if
it is contained whole, so its prefix is one shingle: the rarest by document
frequency over the whole corpus. Documents are joined on that shingle; the length
and positional bounds say where the window would have to start and whether it fits;
then its words are compared.

Both passes over the documents let only those shingles out of a task that pass a bit
table of fixed size, made from the item side. It only lets fewer rows through to the
joins, whose results do not depend on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.llm.tables import bytes_of, fresh, map_rows, row_key, stage
from ctxlens.llm.words import WordHashes, plain_words, run_hashes

WINDOW = 10
SHINGLE = 5
TABLE_BITS = 22

_HASHES = WordHashes()


def _windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, window (its words), size, and each shingle of it as (hash, width, place)."""

    def run(batch):
        out = {c: [] for c in ("item_id", "window", "size", "shingle", "width", "place")}
        for item, text in zip(batch.column("item_id").to_pylist(), bytes_of(batch, "text"), strict=True):
            words = plain_words(text)
            hashes = _HASHES.of(words)
            size = min(window, len(words))
            if not size:
                continue
            width = min(shingle, size)
            runs = run_hashes(hashes, width).view(np.int64).tolist()
            for a in range(len(words) - size + 1):
                content = b" ".join(words[a : a + size])
                for place in range(size - width + 1):
                    for name, value in zip(out, (item, content, size, runs[a + place], width, place), strict=True):
                        out[name].append(value)
        return out

    return map_rows(
        items.select(F.col("item_id").cast("string"), "text"), run,
        "item_id string, window binary, size int, shingle long, width int, place int",
    )


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """Which values the low bits of the hashes take: at most 2**TABLE_BITS bits, whatever the input."""
    low = hashes.select(F.col("shingle").bitwiseAND((1 << TABLE_BITS) - 1).alias("low"))
    words = low.groupBy(F.shiftright("low", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(low & 63 AS int))")).alias("bits")
    )
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    found = words.toPandas()
    table[found.word.to_numpy(np.int64)] = found.bits.to_numpy(np.int64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _passing(hashes: np.ndarray, width: int, tables: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    runs = run_hashes(hashes, width)
    at = np.flatnonzero(tables[width][runs & np.uint64((1 << TABLE_BITS) - 1)])
    return at, runs[at].view(np.int64)


def _frequencies(docs: DataFrame, tables: dict[int, np.ndarray]) -> DataFrame:
    """Number of documents that hold each shingle that passes the tables."""

    def run(batch):
        found = []
        for text in bytes_of(batch, "text"):
            hashes = _HASHES.of(plain_words(text))
            found += [
                (width, h) for width in tables for h in np.unique(_passing(hashes, width, tables)[1]).tolist()
            ]
        counted = pd.Series(found, dtype=object).value_counts()
        return {
            "width": [w for w, _ in counted.index], "shingle": [h for _, h in counted.index],
            "n": counted.to_numpy(np.int64),
        }

    counts = map_rows(docs.select("text"), run, "width int, shingle long, n long")
    return counts.groupBy("width", "shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, tables: dict[int, np.ndarray], window: int) -> DataFrame:
    """One row per document: doc_id, key, n_words and its passing shingles with the words around."""

    def run(batch):
        counts, rows = [], []
        for text in bytes_of(batch, "text"):
            words = plain_words(text)
            hashes = _HASHES.of(words)
            mine = []
            for width in tables:
                for at, h in zip(*map(np.ndarray.tolist, _passing(hashes, width, tables)), strict=True):
                    first = max(0, at - window + width)
                    around = b" ".join(words[first : at + window])
                    mine.append({"shingle": h, "width": width, "at": at, "first": first, "around": around})
            counts.append(len(words))
            rows.append(mine)
        return {
            "doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_words": counts, "found": rows,
        }

    return map_rows(
        docs, run,
        "doc_id long, key long, n_words long, "
        "found array<struct<shingle: long, width: int, at: int, first: int, around: binary>>",
    )


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, n_words) and occurrences (doc_id, key, item_id, start, stop)."""
    windows = stage(_windows(items, window, shingle), "windows")
    widths = [r.width for r in windows.select("width").distinct().collect()]
    tables = {w: _bit_table(windows.where(F.col("width") == w)) for w in sorted(widths)}
    counted = _frequencies(docs, tables)
    grams = windows.drop("item_id").distinct()
    ranked = grams.join(counted, ["width", "shingle"], "left")
    # A shingle that no document holds rules its window out.
    prefix = (
        ranked.groupBy("window", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "width", "place")).alias("p"))
        .where(F.col("p.n") > 0)
        .select("window", "size", "p.shingle", "p.width", "p.place")
    )
    prefix = stage(prefix, "prefix")
    narrow = {w: _bit_table(prefix.where(F.col("width") == w)) for w in tables}
    marked = stage(
        _candidates(
            docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("key")), narrow, window
        ),
        "candidates",
    )
    found = marked.select("doc_id", "key", "n_words", F.inline("found")).join(prefix, ["shingle", "width"])
    start = F.col("at") - F.col("place")
    padded = F.concat(F.lit(b" "), "around", F.lit(b" "))
    skipped = F.col("at") - F.col("place") - F.col("first")
    words = F.split(F.col("around").cast("string"), " ")
    verified = (
        found.where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .where(F.instr(padded.cast("string"), F.concat(F.lit(" "), F.col("window").cast("string"), F.lit(" "))) > 0)
        .where(F.array_join(F.slice(words, skipped + 1, F.col("size")), " ") == F.col("window").cast("string"))
        .select("doc_id", "key", "window", start.alias("start"), (start + F.col("size")).alias("stop"))
    )
    named = stage(windows.select("item_id", "window").distinct(), "named")
    return marked.select("doc_id", "key", "n_words"), verified.join(named, "window").select(
        "doc_id", "key", "item_id", "start", "stop"
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    A document word inside any occurrence of an item window is hit. Items without
    words have no window; null and empty texts have no words and are not
    contaminated; a null item_id is no item's name, but its windows hit. Repeated
    rows give repeated rows. Without items nothing is hit.
    """
    rows, found = hits(docs, items, window, shingle)
    spans = found.groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"),
        F.collect_set("item_id").alias("items"),
    )
    joined = rows.join(
        spans.withColumnsRenamed({"doc_id": "_d", "key": "_k"}),
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left",
    )
    # The union of spans in order of their starts: what each adds beyond the reach so far.
    union = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("reach")),
        lambda acc, x: F.struct(
            (acc.hit + F.greatest(F.lit(0), x.stop - F.greatest(x.start, acc.reach))).cast("long").alias("hit"),
            F.greatest(acc.reach, x.stop).alias("reach"),
        ),
        lambda acc: acc.hit,
    )
    n_hit = F.coalesce(union, F.lit(0).cast("long"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """`docs` without the documents in which an item's window occurs; a null doc_id is judged alike."""
    rows, found = hits(docs, items, window, shingle)
    number, key = fresh(docs, "_doc"), fresh(docs, "_key")
    bad = found.select("doc_id", "key").distinct().toDF(number, key)
    same = F.col("doc_id").eqNullSafe(F.col(number)) & (row_key() == F.col(key))
    return docs.join(bad, same, "left_anti")
