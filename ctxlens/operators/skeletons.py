"""Structural skeletons of code: signatures stay, bodies go.

The Spark job skeletonises each distinct (language, code) once. Equal code is
found by a hash-partitioned distinct with map-side partial aggregation, so a
file that is re-sent with every turn of a session is parsed once, and a hot
file is one row by the time it reaches Python.
"""

from __future__ import annotations

import ast
import hashlib
import re
import textwrap
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.runtime import stage
from ctxlens.sources.parts import Parts

HEADER = "# [structural skeleton: bodies removed]"

SCHEMA = (
    "language STRING, code STRING, skeleton STRING, original_lines INT, "
    "skeleton_lines INT, was_compressed BOOLEAN"
)

STORED = (
    "language string, code_hash string, made_by string, skeleton string, original_lines int, "
    "skeleton_lines int, was_compressed boolean"
)
RULES = 1  # changes with the rules of this module, so that older skeletons are not taken

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _docstring(body: list) -> list:
    """The leading string statement of a body, as a list of none or one."""
    head = body[:1]
    is_text = (
        head
        and isinstance(head[0], ast.Expr)
        and isinstance(head[0].value, ast.Constant)
        and isinstance(head[0].value.value, str)
    )
    return head if is_text else []


def _ellipsis() -> ast.Expr:
    return ast.Expr(ast.Constant(...))


def _bare_class(node: ast.ClassDef, docs: bool, attrs: bool) -> None:
    attributes = (ast.Assign, ast.AnnAssign) if attrs else ()
    members = [
        m
        for m in node.body
        if isinstance(m, (*_FUNCTIONS, ast.ClassDef, *attributes))
    ]
    for member in members:
        if isinstance(member, ast.ClassDef):
            _bare_class(member, docs, attrs)
        elif isinstance(member, _FUNCTIONS):
            member.body = (_docstring(member.body) if docs else []) + [_ellipsis()]
    node.body = (_docstring(node.body) if docs else []) + members or [_ellipsis()]


def _bare_python(code: str, docs: bool, attrs: bool) -> str:
    tree = ast.parse(textwrap.dedent(code))
    pending: list = [tree]
    while pending:
        node = pending.pop()
        if isinstance(node, ast.ClassDef):
            _bare_class(node, docs, attrs)
        elif isinstance(node, _FUNCTIONS):
            node.body = (_docstring(node.body) if docs else []) + [_ellipsis()]
        else:
            pending.extend(ast.iter_child_nodes(node))
    return ast.unparse(ast.fix_missing_locations(tree))


# Every signature ends in a list in round brackets and, after it, one of these.
_GO_REST = re.compile(r"\)[A-Za-z_0-9\[\]*\s]*+\{")
_GO_RECEIVER_REST = re.compile(r"\)\s++[A-Za-z_0-9]++\s*+\(")
_RUST_REST = re.compile(r"\)\s*+(?:->[^{]++)?\{")
_GENERIC_REST = re.compile(r"\)\s*+(?::[A-Za-z_0-9\[\]*.<>?\s]++)?(?:->[A-Za-z_0-9\[\]*.<>?\s]++)?\{")
_NAME = re.compile(r"[A-Za-z_0-9]++\s*+\(")
_SPACE = re.compile(r"\s++")
_GO_WORD = re.compile(r"func(?=\s)")
_RUST_WORD = re.compile(r"fn(?=\s)")
_PLAIN_RUN = re.compile(r"[A-Za-z_0-9\[\]*.<>?\s]++")
_WORD_END = re.compile(r"[A-Za-z_0-9]\Z")


class _Rests:
    """Ends of what follows the first closing bracket at or after a place, each matched once."""

    def __init__(self, text: str, closings: list[int], rest: re.Pattern) -> None:
        self._text, self._closings, self._rest = text, closings, rest
        self._ends: dict[int, int | None] = {}

    def end(self, pos: int) -> int | None:
        i = bisect_left(self._closings, pos)
        if i == len(self._closings):
            return None
        if i not in self._ends:
            match = self._rest.match(self._text, self._closings[i])
            self._ends[i] = match.end() if match else None
        return self._ends[i]


def _space_before(text: str, pos: int) -> int:
    while pos and text[pos - 1].isspace():
        pos -= 1
    return pos


Region = tuple[int, int, int]


def _go_regions(text: str, closings: list[int]) -> Iterator[Region]:
    receivers, lists = (_Rests(text, closings, r) for r in (_GO_RECEIVER_REST, _GO_REST))
    for word in _GO_WORD.finditer(text):
        at = _SPACE.match(text, word.end()).end()
        if text.startswith("(", at):
            opened = receivers.end(at)
        else:
            name = _NAME.match(text, at)
            opened = name.end() if name else None
        end = lists.end(opened) if opened is not None else None
        if end is not None:
            yield _space_before(text, word.start()), word.start(), end


def _rust_regions(text: str, closings: list[int]) -> Iterator[Region]:
    lists = _Rests(text, closings, _RUST_REST)
    for word in _RUST_WORD.finditer(text):
        name = _NAME.match(text, _SPACE.match(text, word.end()).end())
        end = lists.end(name.end()) if name else None
        if end is None:
            continue
        before = _space_before(text, word.start())
        if before < word.start() and text.endswith("pub", 0, before):
            yield _space_before(text, before - 3), before - 3, end
        yield before, word.start(), end


def _generic_regions(text: str, closings: list[int]) -> Iterator[Region]:
    lists = _Rests(text, closings, _GENERIC_REST)
    for run in _PLAIN_RUN.finditer(text):
        if not text.startswith("(", run.end()):
            continue
        last = _space_before(text, run.end()) - 1
        # A name and something before it.
        if last - 1 >= run.start() and _WORD_END.search(text, last, last + 1):
            end = lists.end(run.end())
            if end is not None:
                yield run.start(), last - 1, end


class _Places:
    """Signatures of one kind, found without going over any part of the text twice.

    A region (lo, hi, end) says that a signature whose body opens at `end` can start
    anywhere from lo to hi; regions are in order and apart. A signature starts at the
    position asked for or at a later line start.
    """

    def __init__(self, text: str, regions: Iterator[Region]) -> None:
        self._regions = list(regions)
        self._his = [hi for _, hi, _ in self._regions]
        lined = [(self._line_start(text, lo, hi), end) for lo, hi, end in self._regions]
        self._lined = [(start, end) for start, end in lined if start is not None]
        self._starts = [start for start, _ in self._lined]

    @staticmethod
    def _line_start(text: str, lo: int, hi: int) -> int | None:
        if lo == 0 or text[lo - 1] == "\n":
            return lo
        at = text.find("\n", lo, hi)
        return at + 1 if at >= 0 else None

    def find(self, pos: int) -> int | None:
        """Index after the brace that opens the body of the leftmost signature."""
        i = bisect_left(self._his, pos)
        if i < len(self._his) and self._regions[i][0] <= pos:
            return self._regions[i][2]
        j = bisect_left(self._starts, pos)
        return self._lined[j][1] if j < len(self._lined) else None


_BRACE_TOKEN = re.compile(r"[{}\"']")
_STRING_END = {q: re.compile(r"\\.|" + q, re.DOTALL) for q in "\"'"}


def _body_end(text: str, opening: int) -> int:
    """Index after the brace that closes the one at `opening`; text end if none does."""
    depth, pos = 0, opening
    while token := _BRACE_TOKEN.search(text, pos):
        pos = token.end()
        mark = token.group()
        if mark in _STRING_END:
            closing = next(
                (m for m in _STRING_END[mark].finditer(text, pos) if m.group() == mark),
                None,
            )
            if closing is None:
                break
            pos = closing.end()
            continue
        depth += 1 if mark == "{" else -1
        if depth == 0:
            return pos
    return len(text)


def _bare_braces(code: str) -> str:
    searched = code[: code.rfind("{") + 1]
    closings = [m.start() for m in re.finditer(r"\)", searched)]
    kinds = [
        _Places(searched, regions(searched, closings))
        for regions in (_go_regions, _rust_regions, _generic_regions)
    ]
    out, pos = [], 0
    while pos < len(searched):
        end = next((e for k in kinds if (e := k.find(pos)) is not None), None)
        if end is None:
            break
        out += [code[pos:end], fv.BODY_PLACEHOLDER]
        pos = _body_end(code, end - 1)
    return "".join(out) + code[pos:]


def skeleton_of(
    code: str, language: str, keep_docstrings: bool = False,
    keep_class_attrs: bool = True, header: str = HEADER,
) -> tuple[str, int, int, bool]:
    """(skeleton, original lines, skeleton lines, was compressed) of one text.

    Code that cannot be read, or of another language, comes back unchanged.
    """
    name = language.lower()
    before = len(code.splitlines())
    try:
        if name in fv.PYTHON_NAMES:
            bare = header + "\n" + _bare_python(code, keep_docstrings, keep_class_attrs)
            return bare, before, len(bare.splitlines()), True
        if name in fv.BRACE_LANGUAGES:
            bare = header + "\n" + _bare_braces(code)
            after = len(bare.splitlines())
            return bare, before, after, after < before
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    return code, before, before, False


def skeletons(
    codes: DataFrame,
    keep_docstrings: bool = False,
    keep_class_attrs: bool = True,
    header: str = HEADER,
    require_smaller: bool = False,
) -> DataFrame:
    """Skeletons of the distinct (language, code) rows of `codes`.

    Adds `code_hash` as the join key, so that callers keep code out of later
    shuffles. `require_smaller` also leaves code alone whose skeleton is longer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (lang, code, *skeleton_of(code, lang, keep_docstrings, keep_class_attrs, header))
                for lang, code in zip(batch["language"], batch["code"])
            ]
            yield pd.DataFrame(
                rows,
                columns=[
                    "language", "code", "skeleton", "original_lines",
                    "skeleton_lines", "was_compressed",
                ],
            )

    distinct = codes.select("language", "code").where(F.col("code").isNotNull()).distinct()
    done = distinct.mapInPandas(run, SCHEMA)
    if require_smaller:
        done = done.withColumn(
            "was_compressed",
            F.col("was_compressed") & (F.length("skeleton") < F.length("code")),
        )
    return done.withColumn("code_hash", F.sha2("code", 256))


def _made_by(options: dict) -> str:
    """Names the options and the rules that skeletons were made with."""
    whole = {"keep_docstrings": False, "keep_class_attrs": True, "header": HEADER, "require_smaller": False} | options
    return hashlib.sha256(repr((RULES, sorted(whole.items()))).encode()).hexdigest()[:16]


def stored_skeletons(codes: DataFrame, folder: str | None, **options) -> DataFrame:
    """As `skeletons`, without the code; skeletons are kept in `folder` and not made again.

    The folder holds a table by content: language, hash of the code and options. Only code
    that it does not know is parsed, and added as a part (`sources.parts`); parts are merged
    as they become many, each in the order of hashes, so a reader of few hashes reads few
    row groups. Runs at the same time may add the same code; it counts once.
    """
    if folder is None:
        return skeletons(codes, **options).drop("code")
    spark = codes.sparkSession
    parts, made_by, keys = Parts(spark, folder), _made_by(options), ["language", "code_hash"]
    wanted = stage(
        codes.where(F.col("code").isNotNull()).select("language", "code").distinct().withColumn("code_hash", F.sha2("code", 256)),
        "code",
    )

    def known() -> DataFrame:
        return parts.read(STORED).where(F.col("made_by") == made_by)

    # Written, because the rest depends on what it holds; its columns are read from parquet alone.
    fresh = stage(wanted.join(known().select(*keys), keys, "left_anti"), "fresh-code")
    if not fresh.isEmpty():
        columns = [c.split()[0] for c in STORED.split(", ")]
        made = skeletons(fresh.select("language", "code"), **options).withColumn("made_by", F.lit(made_by))
        parts.append(made.select(*columns).repartitionByRange("code_hash").sortWithinPartitions("code_hash"))
        parts.merge(
            lambda rows: rows.dropDuplicates([*keys, "made_by"]).repartitionByRange("code_hash").sortWithinPartitions("code_hash")
        )
    return known().join(wanted.select(*keys), keys, "left_semi").dropDuplicates(keys).drop("made_by")


def line_stats(done: DataFrame) -> DataFrame:
    """Lines saved and line compression ratio of each skeleton."""
    before, after = F.col("original_lines"), F.col("skeleton_lines")
    return done.select(
        "language",
        "code_hash",
        "original_lines",
        "skeleton_lines",
        (before - after).alias("lines_saved"),
        F.when(before == 0, F.lit(0.0)).otherwise(1.0 - after / before).alias("ratio"),
        "was_compressed",
    )
