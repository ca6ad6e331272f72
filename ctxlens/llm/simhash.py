"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most three differing bits differ in at most three
of their eight bytes, so they share at least five positional bytes. Of five
positions, three lie in the same half of the fingerprint; so the index has one list
for every three positions of a half with their bytes (eight lists per fingerprint).
A pair from a list is kept if the tally of its shared positional bytes reaches five,
and is then verified by its differing bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlens.llm.graph import components
from ctxlens.llm.tables import bytes_of, map_rows, stage
from ctxlens.llm.words import lower_spaced_words

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SLOTS = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
SMALL_LIST = 64
BLOCK = 2048


def fingerprint(text: bytes | None) -> int:
    """64 bits; a bit is set if it is set in over half of the shingles' hashes.

    Shingles are three space-joined words, repeats included; fewer words make one
    shingle; no words give zero.
    """
    words = lower_spaced_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)),
        np.uint64,
        len(starts),
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and `fp`, the fingerprint as a signed long; one row per row of `docs`."""

    def run(batch):
        made = [fingerprint(t) for t in bytes_of(batch, "text")]
        return {
            "doc_id": batch.column("doc_id"),
            "fp": np.array(made, np.uint64).view(np.int64),
        }

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return fp.bitwiseAND(F.lit(255 << (8 * i) if i < 7 else -(1 << 56)))


def _postings(fps: DataFrame) -> DataFrame:
    lists = [
        F.struct(
            F.lit(s).alias("slot"),
            sum((_byte(F.col("fp"), i) for i in t[1:]), _byte(F.col("fp"), t[0])).alias("key"),
        )
        for s, t in enumerate(SLOTS)
    ]
    return fps.select("fp", F.inline(F.array(*lists)))


def _linked(a: Column, b: Column) -> Column:
    """Count filter over shared positional bytes, then the differing bits."""
    differing = a.bitwiseXOR(b)
    shared = sum(
        (F.when(_byte(differing, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0)
    )
    return (shared >= 8 - MAX_BITS) & (F.bit_count(differing) <= MAX_BITS)


def _forest(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Links that join the same values as all links between two blocks do, one per merge."""
    values = np.unique(np.concatenate((left, right)))
    parent = np.arange(len(values))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    places = np.searchsorted(values, right)
    for v in left:
        near = np.bitwise_count((right ^ v).view(np.uint64)) <= MAX_BITS
        i = int(np.searchsorted(values, v))
        for j in np.unique(places[near]):
            r, s = root(i), root(int(j))
            if r != s:
                parent[max(r, s)] = min(r, s)
                out.append((values[i], values[j]))
    return np.array(out, np.int64).reshape(-1, 2)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints; those left out join what others join.

    A list of up to 64 fingerprints is joined with itself. A longer one is cut into
    blocks of about 2,048; every pair of blocks is compared in a task of its own,
    which returns a spanning forest of its links, so a dense group of n
    fingerprints yields a number of links in proportion to n and not to its square.
    """
    posts = _postings(fps)
    # A written table, so that Spark can split the join where a list is hot.
    sizes = stage(posts.groupBy("slot", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "sizes")
    posts = stage(posts.join(sizes, ["slot", "key"]), "postings")
    short = posts.where(F.col("n") <= SMALL_LIST).select("slot", "key", "fp")
    a, b = short.withColumnRenamed("fp", "a"), short.withColumnRenamed("fp", "b")
    pairs = a.join(b, ["slot", "key"]).where(
        (F.col("a") < F.col("b")) & _linked(F.col("a"), F.col("b"))
    )
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    long = (
        posts.where(F.col("n") > SMALL_LIST)
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "slot", "key", "fp", "mine",
            F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        )
    )

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        left = part.fp[part.mine == part.i.iloc[0]].to_numpy()
        right = part.fp[part.mine == part.j.iloc[0]].to_numpy()
        return pd.DataFrame(_forest(left, right), columns=["a", "b"])

    dense = long.groupBy("slot", "key", "i", "j").applyInPandas(compare, "a long, b long")
    return pairs.select("a", "b").union(dense).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id that links lead to, itself included. Equal
    fingerprints are made one before links are looked for, so copies cost nothing.
    Null and empty texts have the fingerprint zero and are linked like any other. A
    null doc_id gets the component of its fingerprint and names none (null if no
    other document is in it). Repeated rows give repeated rows; no rows give none.
    """
    marked = stage(fingerprints(docs), "fingerprints")
    firsts = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    groups = components(links(firsts.select("fp")))
    rooted = firsts.join(groups, firsts.fp == groups.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of near-duplicates: the smallest doc_id.

    Repeated rows of one doc_id count as copies: one stays. A null doc_id stays.
    """
    found = near_duplicates(docs.where(F.col("doc_id").isNotNull()))
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    columns = docs.columns
    first = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*columns)
    return first.union(docs.where(F.col("doc_id").isNull()))
