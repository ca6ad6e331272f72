"""Personal data in texts, disguised or plain, at its places in the source.

Emails, IP addresses, card numbers and phone numbers are found in the text as it is.
Then transducers rewrite it step by step: character references are decoded; lookalike
and compatibility characters become ASCII, invisible ones go; spelled digits become
digits; "at" and "dot" in brackets, as words or with spaces become @ and dots. Each
step keeps what it replaced where, so a span found in the rewritten text leads back,
step by step, to the code points of the source. Every step and search takes time in
proportion to the text.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.llm.tables import fresh, map_rows
from ctxlens.llm.words import plain_words

KINDS = ("email", "ip", "card", "phone")
FOUND = "doc_id long, found array<struct<kind: string, start: long, stop: long, value: string, base: boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits fails or matches as a whole, so only its first digit can start an address.
IP = re.compile(r"([0-9](?<![0-9][0-9])[0-9]*+)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "аеорсухѕіјԁһԛԝкмтвнАВЕКМНОРСТУХЅІЈαορνικυτχεΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡɑօո",
        "aeopcyxsijdhqwkmtbhABEKMHOPCTYXSIJaopvikutxeABEZHIKMNOPTYXigaon",
        strict=True,
    )
) | {"。": ".", "·": ".", "∙": ".", "➕": "+", "−": "-"}

# Names of the digits.
DIGITS = {
    name: str(i % 10)
    for names in (
        "zero one two three four five six seven eight nine",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "oh",
    )
    for i, name in enumerate(names.split())
}
_DIGIT_NAMES = {name.encode() for name in DIGITS}
TIMES = {"double": 2, "triple": 3}
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|co|ch|us"

_NAME = "|".join(sorted(DIGITS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:(double|triple)[\s-]{{1,3}})?({_NAME})(?!\w)", re.I)
PLUS = re.compile(r"(?<!\w)plus\s{1,3}(?=[0-9])", re.I)
MIXED = re.compile(r"(?<![\w@])[0-9OolI|]++(?![\w@])")
REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|commat|period|plus|lpar|rpar|hyphen|nbsp|lowbar);|%(?:40|2[BbEe])")
_BARE = r"(?:\s{1,3}|[-_*~]{1,3})"
_OPEN, _SHUT = r"\s{0,3}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,3}"
AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+-])(?:{_OPEN}(?:at|@|ät|arroba|arobase){_SHUT}"
    rf"|{_BARE}(?:at|arroba|arobase){_BARE}|\s{{0,3}}@\s{{1,3}}|\s{{1,3}}@)(?=[A-Za-z0-9])",
    re.I,
)
DOT = re.compile(
    rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:dot|d0t|\.|punkt|punto|point){_SHUT}"
    rf"|{_BARE}(?:dot|punkt|punto|point){_BARE})(?=[A-Za-z0-9])",
    re.I,
)
LOOSE_DOT = re.compile(rf"(@[A-Za-z0-9.-]++)(\s{{1,2}}\.\s{{0,2}}|\.\s{{1,2}})(?=(?:{ENDINGS})(?![A-Za-z0-9]))", re.I)
# What an "at" needs behind it, in lower case, to make an email.
MAY_BE_AT = re.compile(
    rf"(?:at|@|arroba|arobase)[\s\])}}>*~_-]{{0,7}}[a-z0-9][a-z0-9-]*+(?:\.[a-z0-9]|\s{{0,2}}\.\s{{0,2}}(?:{ENDINGS})(?![a-z0-9]))"
)
HAS_DIGIT = re.compile("[0-9]")
_WORDS_IN_USE = ("dot", "d0t", "punkt", "punto", "point")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and dotted domain."""
    out, done = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end()))
                done = m.end()
    return out


def _is_byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(map(_is_byte, m.groups()))]


def passes_luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(n - 9 * (n > 9) for n in twice)) % 10 == 0


def _is_card(part: str) -> bool:
    digits = _NO_DIGIT.sub("", part)
    return 13 <= len(digits) <= 19 and passes_luhn(digits)


def cards(text: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(text) if _is_card(m[0])]


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]


SEARCHES = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


class Rewritten:
    """A text after one step, with what each replacement stands for in the text before it."""

    def __init__(self, before: str, edits: Iterable[tuple[int, int, str]]) -> None:
        self.at: list[int] = []
        self.ends: list[int] = []
        self.old: list[Span] = []
        parts, length, done = [], 0, 0
        for start, stop, new in edits:
            parts += (before[done:start], new)
            length += start - done
            self.at.append(length)
            length += len(new)
            self.ends.append(length)
            self.old.append((start, stop))
            done = stop
        parts.append(before[done:])
        self.text = "".join(parts)

    def back(self, place: int) -> Span:
        """What the character at a place stands for."""
        i = bisect_right(self.at, place) - 1
        if i < 0:
            return place, place + 1
        if place < self.ends[i]:
            return self.old[i]
        place += self.old[i][1] - self.ends[i]
        return place, place + 1


class Steps:
    """All steps so far; places of the last text lead back to the source."""

    def __init__(self, text: str) -> None:
        self.source = self.text = text
        self.steps: list[Rewritten] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        if edits:
            self.steps.append(Rewritten(self.text, edits))
            self.text = self.steps[-1].text

    def back(self, start: int, stop: int) -> Span:
        """The source's span of a span that holds something."""
        for step in reversed(self.steps):
            start, stop = step.back(start)[0], step.back(stop - 1)[1]
        return start, stop


_folds: dict[str, str] = {}


def folded(c: str) -> str:
    """The ASCII text that a character stands for; itself if none, empty if it is not seen."""
    known = _folds.get(c)
    if known is None:
        digit, wide = unicodedata.digit(c, None), unicodedata.normalize("NFKC", c)
        if c.isascii():
            known = c
        elif unicodedata.category(c) in ("Cf", "Mn", "Me"):
            known = ""
        elif digit is not None:
            known = str(digit)
        elif unicodedata.category(c) == "Pd":
            known = "-"
        elif unicodedata.category(c) == "Zs":
            known = " "
        else:
            known = LOOKALIKES.get(c) or LOOKALIKES.get(wide) or (wide if wide.isascii() else c)
        _folds[c] = known
    return known


def _decoded(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "&" in text or "%" in text:
        for m in REFERENCE.finditer(text):
            new = chr(int(m[0][1:], 16)) if m[0][0] == "%" else html.unescape(m[0])
            out.append((*m.span(), new))
    return out


def _plain(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    odd = "".join(re.escape(c) for c in sorted(set(text)) if folded(c) != c)
    return [(*m.span(), folded(m[0])) for m in re.finditer(f"[{odd}]", text)] if odd else []


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Two and more names of digits in a row, or one between digits or beside a dot."""
    if _DIGIT_NAMES.isdisjoint(plain_words(text.encode())):
        return []
    out: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []

    def close() -> None:
        if not run:
            return
        start, stop = run[0][0], run[-1][1]
        before, after = text[max(0, start - 3) : start], text[stop : stop + 3]
        between = re.search(r"[0-9][ -]$|\+\s?$", before) and re.match(r"[ -][0-9]", after)
        if len(run) > 1 or len(run[0][2]) > 1 or between or before[-1:] == "." or re.match(r"\.\w", after):
            at = start
            for s, e, new in run:
                if at < s:
                    out.append((at, s, ""))
                out.append((s, e, new))
                at = e
        run.clear()

    for m in SPELLED.finditer(text):
        if run and not re.fullmatch(r"\s{1,3}|\s?[-,]\s?", text[run[-1][1] : m.start()]):
            close()
        times = TIMES[m[1].lower()] if m[1] else 1
        run.append((*m.span(), DIGITS[m[2].lower()] * times))
    close()
    return out


def _mixed(text: str) -> list[tuple[int, int, str]]:
    """Letters that look like 0 and 1 in runs that are digits for the greater part."""
    out = []
    if not HAS_DIGIT.search(text):
        return out
    for m in MIXED.finditer(text):
        odd = [i for i, c in enumerate(m[0], m.start()) if c not in "0123456789"]
        if odd and 2 * len(odd) < len(m[0]):
            out += [(i, i + 1, "0" if text[i] in "Oo" else "1") for i in odd]
    return out


def _plus(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "+") for m in PLUS.finditer(text)] if "plus" in text.lower() else []


def _ats(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@") for m in AT.finditer(text)] if MAY_BE_AT.search(text.lower()) else []


def _loose_dots(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(2), ".") for m in LOOSE_DOT.finditer(text)] if "@" in text else []


def _dots(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(w in low for w in _WORDS_IN_USE) and not re.search(r"[\[({<]\s{0,2}\.", text):
        return []
    return [(*m.span(), ".") for m in DOT.finditer(text)]


def normalised(text: str) -> Steps:
    """The text after all steps."""
    steps = Steps(text)
    for step in (_decoded, _plain, _dots, _spelled, _plus, _mixed, _ats, _loose_dots):
        steps.rewrite(step(steps.text))
    return steps


def _is_address(steps: Steps, start: int, stop: int) -> bool:
    """An added email ends in letters; with a bare "at" it needs a disguised dot or a telling name."""
    name, domain = steps.text[start:stop].split("@")
    ending = domain.rpartition(".")[2]
    if not (ending.isalpha() and 2 <= len(ending) <= 24):
        return False
    at = start + len(name)
    a, b = steps.back(at, at + 1)
    if "@" in steps.source[a:b] or re.search(r"[\[({<&%＠﹫]", steps.source[a:b]):
        return True
    places = [i for i in range(at + 1, stop) if steps.text[i] == "."]
    dots = [steps.source[slice(*steps.back(i, i + 1))] for i in places]
    if any(len(d) > 1 for d in dots):
        return len(ending) <= 6
    return bool(re.search(r"[._%+0-9-]", name))


def _runs_on(text: str, start: int, stop: int, base: list[Span]) -> bool:
    """Words that name digits before or after an identifier that is whole without them."""
    return any(
        start <= a and b <= stop and any(map(str.isalpha, text[start:a] + text[b:stop]))
        for a, b in base[bisect_right(base, (start, 0)) : bisect_right(base, (stop, 0))]
    )


def _more_cards(steps: Steps, start: int, stop: int) -> list[Span]:
    """Cards among groups of digits that stand in one row with others but are all disguised."""
    out, row = [], []
    for m in [*re.finditer("[0-9]+", steps.text[start:stop]), None]:
        span = m and (start + m.start(), start + m.end())
        if span and steps.source[slice(*steps.back(*span))] != m[0]:
            row.append(span)
            continue
        if row and _is_card(steps.text[row[0][0] : row[-1][1]]):
            out.append((row[0][0], row[-1][1]))
        row = []
    return out


def found_in(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, stop, identifier, base) of all spans, by kind as listed, then by place."""
    steps = normalised(text)
    out = []
    for kind, search in SEARCHES.items():
        base = search(text)
        spans = [(a, b, text[a:b], True) for a, b in base]
        if steps.steps:
            made = search(steps.text)
            if kind == "card":
                whole = set(made)
                for m in CARD.finditer(steps.text):
                    if m.span() not in whole:
                        made += _more_cards(steps, *m.span())
            for a, b in made:
                start, stop = steps.back(a, b)
                i = bisect_right(base, (start, len(text) + 1)) - 1
                inside = i >= 0 and stop <= base[i][1]
                if inside or text[start:stop] == steps.text[a:b]:
                    continue
                if kind == "email" and not _is_address(steps, a, b):
                    continue
                if kind in ("card", "phone") and _runs_on(text, start, stop, base):
                    continue
                spans.append((start, stop, steps.text[a:b], False))
        out += [(kind, *s) for s in sorted(set(spans))]
    return out


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id and `found` of each row: kind, start, stop, value and base of each span.

    Spans are in code points, the end exclusive; `value` is the identifier without its
    disguise, `base` tells spans found in the text as it is from those that the steps
    add. Spans are listed by kind (email, ip, card, phone), then by place. A null or
    empty text has none; a null doc_id stays null; repeated rows give repeated rows; other
    columns are ignored; no rows give none. A text is read whole by one task.
    """

    def run(batch):
        rows = [found_in(t) if t else [] for t in batch.column("text").to_pylist()]
        names = ("kind", "start", "stop", "value", "base")
        return {
            "doc_id": batch.column("doc_id"),
            "found": [[dict(zip(names, s, strict=True)) for s in row] for row in rows],
        }

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, FOUND)


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with each found span of `text` replaced by its kind in brackets, as `[EMAIL]`.

    Spans that overlap are replaced as one, named after the first. Columns of any name
    stay as they are; a null text stays null.
    """
    name = fresh(docs, "_text")

    def run(batch):
        out = []
        for text in batch.column(name).to_pylist():
            edits: list[tuple[int, int, str]] = []
            for kind, start, stop, *_ in sorted(found_in(text) if text else [], key=lambda s: (s[1], -s[2])):
                if edits and start < edits[-1][1]:
                    edits[-1] = (edits[-1][0], max(stop, edits[-1][1]), edits[-1][2])
                else:
                    edits.append((start, stop, f"[{kind.upper()}]"))
            out.append(Rewritten(text, edits).text if edits else text)
        return {c: batch.column(c) for c in batch.schema.names} | {"text": out}

    marked = docs.withColumnRenamed("text", name).withColumn("text", F.col(name))
    types = ", ".join(f"`{c}` {t}" for c, t in marked.dtypes)
    return map_rows(marked, run, types).drop(name).select(*docs.columns)
