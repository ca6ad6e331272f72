"""Spelling variants: words one edit apart, found by composing finite-state machines.

A group's vocabulary is the smallest acyclic acceptor of its words. Composed with a
transducer that passes symbols through, makes one edit and passes symbols through
again, and with the acceptor once more, it accepts exactly the pairs of words one edit
apart. Before the edit both acceptors are in the same state; after it they must accept
a common rest, so the states of the composition are states of the acceptor and pairs of
them, each worked out once. No words are compared pair by pair.

The composition is dealt by initial states. Two words of six letters or more, one edit
apart, share their first three or their last three letters; so each word enters the
composition once after its beginning and once before its end. A state that too many
words reach is replaced by states further on: of the letters between the shared
beginning and end, two words share the first or the last half, until groups are small
or only two letters are left open.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.llm.tables import bytes_of, stage

LEAST_LETTERS = 6
LEAST_COUNT = 5
FACTOR = 5
SHARED = 3
GROUP = 16384
MAX_COUNTED = 400_000
RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def runs_of(text: bytes | None) -> list[str]:
    """Maximal runs of letters with at least `LEAST_LETTERS`, A-Z lower-cased."""
    return RUNS.findall(text.translate(_LOWER).decode()) if text else []


def damaged(number: int | None, run: str, every: int, start: int) -> str:
    """The run, or without one letter where `every` divides the checksum of number and run."""
    if number is None or not every:
        return run
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, every: int = 0, least: int = LEAST_COUNT) -> DataFrame:
    """word and n: words of six letters or more that occur at least `least` times in all texts.

    With `every`, one run in so many loses a letter, chosen by the CRC-32 of
    `<doc_id>:<run>`; runs of a null doc_id lose none. Counts are summed in each task before
    they are shuffled, in a table of bounded size. Null and empty texts have no words;
    repeated rows count again.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch, "text"), strict=True):
                start = zlib.crc32(f"{number}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    word = damaged(number, run, every, start)
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += n
                if len(counts) >= MAX_COUNTED:
                    yield emit(counts)
                    counts.clear()
        yield emit(counts)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptor:
    """The smallest deterministic acyclic acceptor of words given in rising order."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self._known: dict[tuple, int] = {}
        self._meets: dict[tuple[int, int], tuple | None] = {}
        path: list[int] = [0]
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            self._settle(path, before, same)
            for letter in word[same:]:
                state = self._new()
                self.arcs[path[-1]][letter] = state
                path.append(state)
            self.final[path[-1]] = True
            before = word
        self._settle(path, before, 0)

    def _new(self) -> int:
        self.arcs.append({})
        self.final.append(False)
        return len(self.arcs) - 1

    def _settle(self, path: list[int], word: str, keep: int) -> None:
        """Replace the states behind the first `keep` letters by equal ones that are known."""
        while len(path) > keep + 1:
            state = path.pop()
            key = (self.final[state], *self.arcs[state].items())
            known = self._known.setdefault(key, state)
            if known != state:
                self.arcs[path[-1]][word[len(path) - 1]] = known

    def meet(self, p: int, q: int) -> tuple | None:
        """(accepting, arcs) of the state that follows both; null if no common rest is left."""
        meets, arcs = self._meets, self.arcs
        top = (p, q) if p <= q else (q, p)
        open_ = [top]
        while open_:
            pair = open_[-1]
            if pair in meets:
                open_.pop()
                continue
            a, b = arcs[pair[0]], arcs[pair[1]]
            if len(b) < len(a):
                a, b = b, a
            steps = [(c, (s, b[c]) if s <= b[c] else (b[c], s)) for c, s in a.items() if c in b]
            wanted = [t for _, t in steps if t not in meets]
            if wanted:
                open_ += wanted
                continue
            steps = [(c, t) for c, t in steps if meets[t] is not None]
            ends = self.final[pair[0]] and self.final[pair[1]]
            meets[pair] = (ends, steps) if ends or steps else None
            open_.pop()
        return meets[top]

    def _rests(self, p: int, q: int) -> Iterator[str]:
        """All words that both states accept."""
        if self.meet(p, q) is None:
            return
        open_ = [((p, q) if p <= q else (q, p), "")]
        while open_:
            pair, read = open_.pop()
            ends, steps = self._meets[pair]
            if ends:
                yield read
            open_ += [(t, read + c) for c, t in steps]

    def _edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of rests from one state whose edit comes at once: replaced, or one letter more."""
        out = []
        letters = list(self.arcs[state].items())
        for i, (a, p) in enumerate(letters):
            # One letter more comes last among equal ones, so each pair has one edit only.
            if self.final[p] and self.final[state]:
                out.append((a, ""))
            for c, q in letters:
                if c != a and c in self.arcs[p]:
                    out += [(a + c + rest, c + rest) for rest in self._rests(self.arcs[p][c], q)]
            for b, q in letters[i + 1 :]:
                out += [(a + rest, b + rest) for rest in self._rests(p, q)]
        return out

    def near(self) -> Iterator[tuple[str, str]]:
        """Pairs of accepted words one edit apart, each once."""
        edits: dict[int, list] = {}
        open_ = [(0, "")]
        while open_:
            state, read = open_.pop()
            if state not in edits:
                edits[state] = self._edits(state)
            for a, b in edits[state]:
                yield read + a, read + b
            open_ += [(s, read + c) for c, s in self.arcs[state].items()]


def _entered(words: DataFrame) -> DataFrame:
    """Each word after its first and before its last letters: head, rest, tail; open is -1 (any length)."""
    w, k = F.col("word"), SHARED
    length = F.length(w)
    ways = F.array(
        F.struct(w.substr(1, k).alias("head"), w.substr(F.lit(k + 1), length).alias("rest"), F.lit("").alias("tail")),
        F.struct(F.lit("").alias("head"), w.substr(F.lit(1), length - k).alias("rest"), w.substr(length - k + 1, F.lit(k)).alias("tail")),
    )
    return words.select(F.inline(ways)).withColumn("open", F.lit(-1))


def _further(groups: DataFrame) -> DataFrame:
    """Each word of a group in the groups that replace it.

    `open` is the number of letters that the shorter word of a pair has between head and
    tail; a pair shares the first or the last half of them.
    """
    length = F.length("rest")
    lengths = F.when(F.col("open") >= 0, F.array("open")).otherwise(F.filter(F.array(length, length - 1), lambda x: x >= 0))
    groups = groups.withColumn("open", F.explode(lengths)).withColumn("half", F.floor(F.col("open") / 2).cast("int"))
    rest, half = F.col("rest"), F.col("half")
    left = (F.col("open") - half).alias("open")
    ways = F.array(
        F.struct(
            F.concat("head", rest.substr(F.lit(1), half)).alias("head"),
            rest.substr(half + 1, F.length(rest)).alias("rest"), F.col("tail").alias("tail"), left,
        ),
        F.struct(
            F.col("head").alias("head"), rest.substr(F.lit(1), F.length(rest) - half).alias("rest"),
            F.concat(rest.substr(F.length(rest) - half + 1, half), F.col("tail")).alias("tail"), left,
        ),
    )
    # With nothing to halve (0 or 1 letters open) both ways are the same group.
    return groups.select(F.inline(F.when(half > 0, ways).otherwise(F.slice(ways, 1, 1))))


KEYS = ["head", "tail", "open"]


def _composed(groups: DataFrame) -> DataFrame:
    """word and other of all near pairs of each group; a task holds one group at a time."""
    schema = pa.schema([("word", pa.string()), ("other", pa.string())])

    def solve(key: tuple, rests: list[str]) -> Iterator[pa.RecordBatch]:
        if len(rests) > 1:
            head, tail, _ = key
            pairs = [sorted((head + a + tail, head + b + tail)) for a, b in Acceptor(rests).near()]
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], schema=schema
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rests = None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (*KEYS, "rest"))
            for *key, rest in zip(*columns, strict=True):
                if key != now:
                    yield from solve(now, rests)
                    now, rests = key, []
                rests.append(rest)
        yield from solve(now, rests)

    dealt = groups.select(*KEYS, "rest").repartition(*KEYS).sortWithinPartitions(*KEYS, "rest")
    return dealt.mapInArrow(run, "word string, other string")


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word and other (word < other) one edit apart, each pair once, of distinct words.

    Words have at least `LEAST_LETTERS` letters. No group of more than `group` words is
    put into one task, unless it has no more than two letters open (then the square of the
    alphabet bounds it).
    """
    now, pairs = stage(_entered(words.select("word")), "groups"), None
    while True:
        large = stage(
            now.groupBy(*KEYS).agg(F.count("*").alias("n"))
            .where((F.col("n") > group) & ~F.col("open").between(0, 1)).select(*KEYS),
            "large",
        )
        more = not large.isEmpty()
        made = _composed(now.join(large, KEYS, "left_anti") if more else now)
        pairs = made if pairs is None else pairs.union(made)
        if not more:
            return pairs.distinct()
        now = stage(_further(now.join(large, KEYS, "left_semi")).distinct(), "groups")


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the end of the chain of forms that starts at each word; `forms` has word and form.

    Steps are doubled, so a chain of n forms takes about log n rounds of one join.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.toDF("root", "next")
        made = stage(
            now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        now = made.select("word", "root")
        if made.where("moved").isEmpty():
            return now


def variants(words: DataFrame, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `words` (word, n).

    Words are near if one inserted, deleted or replaced letter tells them apart. A word's
    form is its near word of largest n (ties: the smallest in code-point order) if that n is
    at least `factor` times its own, else null; its root is the last word that forms lead
    to, itself without a form. n_near is the number of near words. `words` holds each word
    once, with at least six letters; a null word or n takes no part. No words give no rows.
    """
    words = stage(words.where(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", "n"), "words")
    pairs = stage(near_pairs(words, group), "pairs")
    both = pairs.union(pairs.select("other", "word")).toDF("word", "other")
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other")))
    near = both.join(words.toDF("other", "m"), "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= factor * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("m"))).alias("to"),
    )
    judged = stage(judged.select("word", "n", "n_near", F.col("to.form").alias("form"), F.col("to.m").alias("form_n")), "forms")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
