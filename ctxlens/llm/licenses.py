"""License scan: MinHash bands over overlapping windows, verified by exact containment.

Documents are cut into overlapping windows of twice a template's length class, half of
the class apart, so every text span no longer than the class lies whole in a window.
Windows that hold too few shingles of the class's templates for any of them cannot
match and are passed over. The others get MinHash signatures; one agreeing band
retrieves a template. With 96 bands of one row, a window that holds 0.8 of a template's
shingles (a Jaccard similarity of 0.19 or more, as a window has at most four times a
template's shingles) is found with a probability above 1 - 2e-9; for templates of one
shingle (up to 5 words, a similarity of 1 in 14 or more) it is above 1 - 9e-4 a window,
and several windows hold each. The shingles of each retrieved pair are then compared.
"""

from __future__ import annotations

import math
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.llm.tables import bytes_of, map_rows, row_key, stage
from ctxlens.llm.words import WordHashes, mix, plain_words, run_hashes

SHINGLE = 5
BANDS = 96
CONTAINMENT = 0.8
FILTER = 1 << 20
NOTICE = 8


def _notices(names: list[str], *others: str) -> tuple[str, ...]:
    """Usual wordings of a notice, for each way to write a license's name.

    Of NOTICE words at most, the last ones, so that another version is never near enough.
    """
    forms = ("under the {}", "under an {}", "under a {}", "under {}", "under the terms of the {}",
             "under terms of the {}", "subject to the terms of the {}", "under the terms and conditions of the {}")
    texts = (plain_words(f.format(n).encode())[-NOTICE:] for n in names for f in forms)
    return tuple(dict.fromkeys(b" ".join(t).decode() for t in texts)) + others


def _gnu(kind: str, short: str, version: str) -> tuple[str, ...]:
    """Wordings of the notices of one version of a GNU license."""
    number = version.removesuffix(".0")
    written = {version, number}
    names = [f"GNU {kind} {by}{v}" for v in sorted(written) for by in ("version ", "v", "")]
    names += [f"{short}{by}{v}" for v in sorted(written) for by in (" version ", " v", "v", "-", "")]
    return _notices(
        names, f"SPDX-License-Identifier: {short}-{version}",
        *(f"version {v} of the GNU {kind}" for v in sorted(written)),
    )


def _header(kind: str, version: str) -> str:
    """The passage of the GNU file headers that tells licenses and versions apart."""
    return (
        f"under the terms of the GNU {kind} as published by the Free Software Foundation, "
        f"either version {version} of the License"
    )


def _creative(code: str, title: str) -> tuple[str, ...]:
    """Wordings of the notices of a Creative Commons 4.0 license."""
    return _notices(
        [f"Creative Commons {title} 4.0", f"CC {code} 4.0", f"CC-{code}-4.0 license"],
        f"SPDX-License-Identifier: CC-{code}-4.0", f"creativecommons.org/licenses/{code.lower()}/4.0",
    )


# Fixed values. Opening passages and passages of file headers are as published; notices are the usual
# wordings by which works name a license, not texts of the licenses. Whole texts, as published and without
# copyright lines, are the files of license_texts; the 2-clause BSD text is the 3-clause one without its third. A name may have several texts, each a template of its own.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "mit-notice": _notices(["MIT License", "MIT/X11 License", "Expat License"], "SPDX-License-Identifier: MIT"),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "apache-2.0-notice": _notices(
        ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache-2.0 license", "Apache 2 license",
         "Apache Software License, Version 2.0"],
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-3.0-notice": _gnu("General Public License", "GPL", "3.0"),
    "gpl-3.0": _header("General Public License", "3"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies."
    ),
    "gpl-2.0-notice": _gnu("General Public License", "GPL", "2.0"),
    "gpl-2.0": _header("General Public License", "2"),
    "lgpl-2.1-notice": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "lgpl-2.1": _header("Lesser General Public License", "2.1"),
    "lgpl-3.0": _header("Lesser General Public License", "3"),
    "lgpl-3.0-notice": _gnu("Lesser General Public License", "LGPL", "3.0"),
    "agpl-3.0-notice": _gnu("Affero General Public License", "AGPL", "3.0"),
    "agpl-3.0": _header("Affero General Public License", "3"),
    "mpl-2.0-notice": _notices(
        ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
        "subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0",
    ),
    "bsd-notice": _notices(
        ["BSD license", "BSD 2-Clause License", "BSD 3-Clause License", "2-clause BSD license", "3-clause BSD license",
         "BSD-style license", "New BSD License", "modified BSD license", "simplified BSD license"],
        "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "isc-notice": _notices(["ISC License"], "SPDX-License-Identifier: ISC"),
    "unlicense-notice": _notices(
        ["Unlicense"], "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"
    ),
    "cc0-1.0-notice": _notices(
        ["CC0 1.0", "Creative Commons Zero", "Creative Commons CC0", "CC0 license"],
        "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "creativecommons.org/publicdomain/zero/1.0",
    ),
    "cc-by-4.0-notice": _creative("BY", "Attribution"),
    "cc-by-sa-4.0-notice": _creative("BY-SA", "Attribution-ShareAlike"),
    "cc-by-nd-4.0-notice": _creative("BY-ND", "Attribution-NoDerivatives"),
    "cc-by-nc-4.0-notice": _creative("BY-NC", "Attribution-NonCommercial"),
    "cc-by-nc-sa-4.0-notice": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "cc-by-nc-nd-4.0-notice": _creative("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
} | {
    f"{file.name.removesuffix('.txt')}-text": file.read_text("utf-8")
    for file in sorted((resources.files("ctxlens.llm") / "license_texts").iterdir(), key=lambda f: f.name)
    if file.name.endswith(".txt")
}

_HASHES = WordHashes()
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of a text; fewer words than a shingle make one."""
    return run_hashes(_HASHES.of(words), min(size, len(words))) if words else np.empty(0, np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    """Least value of each of the seeded permutations."""
    return np.array([mix(values ^ s).min() for s in _SEEDS], np.uint64)


def length_class(words: int) -> int:
    """The power of two that holds so many words, eight at least."""
    return max(8, 1 << (words - 1).bit_length())


def _template_rows(templates: dict[str, str | tuple[str, ...]]) -> list[tuple]:
    rows = []
    texts = [(name, t) for name, given in templates.items() for t in ([given] if isinstance(given, str) else given)]
    for number, (name, text) in enumerate(texts):
        words = plain_words(text.encode())
        if words:
            own = np.unique(shingles(words))
            rows.append((number, name, length_class(len(words)), min(SHINGLE, len(words)), own, signature(own)))
    return rows


def _windows(docs: DataFrame, known: dict[tuple[int, int], tuple[np.ndarray, int]]) -> DataFrame:
    """Windows with shingles enough for a template: class, width, start, stop, shingles, signature.

    `known` has the shingles of a class's templates and how many a match takes at least.
    """
    low = np.uint64(FILTER - 1)
    every: dict[int, np.ndarray] = {}
    for (_, width), (wanted, _) in known.items():
        every[width] = np.union1d(every.get(width, wanted[:0]), wanted)

    def run(batch):
        out = {c: [] for c in ("doc_id", "key", "class", "width", "start", "stop", "own", "bands")}
        filters: dict[int, np.ndarray] = {}  # low bits of all shingles of a width; most places end here
        for width, wanted in every.items():
            filters[width] = np.zeros(FILTER, bool)
            filters[width][wanted & low] = True
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "key"))
        for number, key, text in zip(*columns, bytes_of(batch, "text"), strict=True):
            hashes = _HASHES.of(plain_words(text))
            all_runs = {width: run_hashes(hashes, width) for width in filters}
            hits = {}
            for width, held in filters.items():
                likely = np.flatnonzero(held[all_runs[width] & low])
                values, wanted = all_runs[width][likely], every[width]
                place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
                hits[width] = likely[wanted[place] == values]
            for (size, width), (wanted, least) in known.items():
                runs, at = all_runs[width], hits[width]
                if len(at):
                    at = at[np.isin(runs[at], wanted)]
                if len(at) < least:
                    continue
                step = size // 2
                last = np.maximum(at + width - 2 * size + step - 1, 0) // step  # first window that reaches the shingle's end
                spans = {w for a, b in zip(last.tolist(), (at // step).tolist(), strict=True) for w in range(a, b + 1)}
                for w in sorted(spans):
                    start, stop = w * step, min(w * step + 2 * size, len(hashes))
                    end = max(start, stop - width + 1)
                    if end == start or np.searchsorted(at, end) - np.searchsorted(at, start) < least:
                        continue
                    own = np.unique(runs[start:end])
                    values = (
                        number, key, size, width, start, stop, own.view(np.int64), signature(own).view(np.int64)
                    )
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
        return out

    return map_rows(
        docs, run,
        "doc_id long, key long, class int, width int, start int, stop int, own array<long>, bands array<long>",
    )


def scanned(
    docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, containment: float = CONTAINMENT
) -> DataFrame:
    """doc_id, license, containment, start and stop of every license found in a document.

    One row per document and license: the window with the greatest containment, the
    first among equals; start and stop are its word range. Templates are few and
    given by name, one text or several; those without words match nothing, like null and empty texts. A
    null doc_id is reported as such. Equal rows of a doc_id give one row.
    """
    rows = _template_rows(TEMPLATES if templates is None else templates)
    spark = docs.sparkSession
    known: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
    for _, _, size, width, own, _ in rows:
        before, least = known.get((size, width), (own[:0], len(own)))
        takes = max(1, math.ceil(containment * len(own) - 1e-9))
        known[size, width] = np.union1d(before, own), min(least, takes)
    windows = stage(
        _windows(docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("key")), known), "windows"
    )
    template = spark.createDataFrame(
        [(i, n, s, w, own.view(np.int64).tolist(), sig.view(np.int64).tolist()) for i, n, s, w, own, sig in rows],
        "template int, license string, class int, width int, theirs array<long>, bands array<long>",
    )
    place = ["doc_id", "key", "class", "width", "start"]
    banded = windows.select(*place, F.posexplode("bands").alias("band", "least"))
    theirs = template.select("template", "class", "width", F.posexplode("bands").alias("band", "least"))
    # As many rows as templates times bands.
    found = banded.join(F.broadcast(theirs), ["class", "width", "band", "least"]).select(*place, "template").distinct()
    found = found.toDF(*(f"_{c}" for c in place), "template")
    held = windows.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place])
    share = F.size(F.array_intersect("own", "theirs")) / F.size("theirs")
    verified = (
        held.join(F.broadcast(template.select("template", "license", "theirs")), "template")
        .withColumn("containment", share)
        .where(F.col("containment") >= containment)
    )
    best = F.max(F.struct("containment", (-F.col("start")).alias("_s"), "stop")).alias("b")
    return verified.groupBy("doc_id", "license").agg(best).select(
        "doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b._s")).alias("start"), F.col("b.stop").alias("stop")
    )
