"""Token ids of whole texts by a byte-level BPE vocabulary file.

A text is cut before every single space, around runs of white space and where a word
of Latin letters ends, places where byte-level BPE pre-tokenization always cuts too; so the pieces can be encoded alone
and their ids kept in a bounded cache of each worker. Arrow cuts a batch at its single
spaces and finds the distinct words, so only those are looked up; texts with other
white space after a space are cut by a regular expression. New pieces are encoded many
at a time, a line each. Texts that hold characters on
which Python's and the tokenizer's notions of white space differ are encoded whole, and
so are texts that hold an added token such as `<|endoftext|>`, which has one id.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CACHED = 600_000
LONGEST_CACHED = 48
LINES = 16
# A run of Latin letters ends at white space, comma or full stop in the tokenizer's pattern too.
_PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s,.])| ?\S+|\s+(?!\S)|\s+")
# Patterns of Arrow's own syntax.
_ODD = r"[\x{1c}-\x{1f}\x{85}\x{180e}]"
_RUN = r" [\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_KNOWN: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *map(re.escape, added)])
        self.line = np.frombuffer(self._encoded(["\n"])[0], "<u4")

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _by_lines(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space but a leading space: a line feed is always cut off."""
        joined = ["\n".join(pieces[k : k + LINES]) + "\n" for k in range(0, len(pieces), LINES)]
        data = b"".join(self._encoded(joined))
        if not data:
            return []
        ends = np.flatnonzero(np.frombuffer(data, "<u4") == self.line[0]) * 4
        starts = np.concatenate(([0], ends[:-1] + 4))
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _add(self, pieces: list[str]) -> None:
        if len(self.line) == 1:
            lined = [p for p in pieces if not p.isspace()]
            self.cache.update(zip(lined, self._by_lines(lined), strict=True))
            pieces = [p for p in pieces if p.isspace()]
        self.cache.update(zip(pieces, self._encoded(pieces), strict=True))

    def _of(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of texts; the pieces that they are cut into are kept."""
        cache = self.cache
        if len(cache) > MAX_CACHED:
            cache.clear()
        out = list(map(cache.get, parts))
        words, others = [], []
        for k, ids in enumerate(out):
            if ids is None:
                p = parts[k]
                (words if p[:1] == " " and p[1:].isalpha() else others).append(k)
        new = [parts[k] for k in words]
        self._add(new)
        cut = [_cut(parts[k]) for k in others]
        more = list(set().union(*cut).difference(cache))
        self._add(more)
        for k, p in zip(words, new, strict=True):
            out[k] = cache[p]
        for k, own in zip(others, cut, strict=True):
            out[k] = b"".join([cache[p] for p in own])
        for p in {p for some in (new, more) for p in some if len(p) > LONGEST_CACHED}:
            del cache[p]
        return out

    def _spaced(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts in which no white space follows a space."""
        cut = pc.split_pattern(texts, " ")
        words, first = cut.flatten(), cut.offsets.to_numpy()[:-1]
        later = np.ones(len(words), bool)
        later[first] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        parts = [" " + w for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        at = np.empty(len(words), np.int64)
        at[later] = coded.indices.to_numpy()
        at[first] = np.arange(len(parts), len(parts) + len(first))
        parts += words.take(pa.array(first)).to_pylist()
        ids = pa.array(self._of(parts), pa.large_binary()).take(pa.array(at))
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[[*first, len(words)]].tolist()
        data = memoryview(data or b"")
        return [data[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; none for null."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.odd)
        runs = pc.and_not(pc.match_substring_regex(texts, _RUN), whole)
        out = self._spaced(pc.if_else(pc.or_(whole, runs), "", texts))
        for some, ids_of in ((whole, self._encoded), (runs, self._of)):
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            if len(at):
                for k, ids in zip(at.tolist(), ids_of(texts.take(pa.array(at)).to_pylist()), strict=True):
                    out[k] = ids
        return out


def _cut(part: str) -> Sequence[str]:
    """The pieces of a part of a text; a word and its comma or full stop need no regular expression."""
    if part[:1] == " " and part[-1] in ",." and part[1:-1].isalpha() and part[-2] <= "ÿ":
        return part[:-1], part[-1]
    return _PIECES.findall(part)


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if path not in _KNOWN:
        _KNOWN[path] = Encoder(path)
    return _KNOWN[path]
