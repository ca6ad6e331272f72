"""Each operator against brute force, and on null, empty, repeated and odd rows."""

import hashlib
import random
import zlib
from datetime import date

import numpy as np
import pytest

from ctxlens.llm import (
    chat, decontaminate, extract, graph, knn, licenses, packing, simhash, substrings, toxicity, url_lists,
)
from ctxlens.llm.catalog import vocabulary_path
from ctxlens.llm.words import plain_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, key int"


def made_texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    passage = rng.choices(vocabulary, k=90)
    texts = [rng.choices(vocabulary, k=rng.randint(0, 160)) for _ in range(n)]
    for i in range(5, n, 5):
        at = rng.randint(0, len(texts[i]))
        cut = rng.randint(0, 30)
        texts[i][at:at] = passage[cut : cut + rng.randint(20, 60)]
    for i in range(7, n, 7):
        texts[i] = list(texts[i - 7])
        if texts[i] and i % 2:
            texts[i][len(texts[i]) // 2] = "zz"
    texts[3] = ["same"] * 200
    texts[4] = ["same"] * 120
    return [" ".join(t) for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    texts = made_texts(60)
    rows = [(i, t, "en", "src0", len(t), "x", 1) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, "", 0), (None, texts[1], "en", "s", 1, "", 0)]
    rows += [rows[2], rows[2]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def brute_kept(rows, window=50):
    first = {}
    for number, text in rows:
        words = (text or "").encode().split()
        for p in range(len(words) - window + 1):
            if number is not None:
                key = tuple(words[p : p + window])
                first[key] = min(first.get(key, number), number)
    out = []
    for number, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for p in range(len(words) - window + 1):
            if number is not None and first[tuple(words[p : p + window])] < number:
                gone.update(range(p, p + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((number, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def by_text(rows):
    return sorted(map(str, rows))


def test_substrings(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in substrings.removed_repeats(docs).collect()]
    assert by_text(got) == by_text(brute_kept(rows))
    assert any(r[2] for r in got)
    assert substrings.removed_repeats(no_docs).count() == 0
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    digest = {(r.doc_id, hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest()) for r in cut.collect() if r.text}
    assert digest == {(n, h) for n, w, _, h in got if w and h != hashlib.sha256(b"").hexdigest()}


def test_substrings_same_number_other_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words), (2, "other " + words), (0, "short")]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.removed_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 60, 0), (2, 60, 60), (2, 61, 60), (0, 1, 0)}


def brute_components(fps, most=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def brute_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for (number, _), root in zip(rows, roots):
        if number is not None:
            least[root] = min(least.get(root, number), number)
    want = [(n, f"{f:016x}", least[r]) for (n, _), f, r in zip(rows, fps, roots)]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert by_text(got) == by_text(want)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values()))


def test_simhash_dense_lists(spark, monkeypatch):
    """Long lists in blocks join the same fingerprints as all pairs do."""
    monkeypatch.setattr(simhash, "SMALL_LIST", 4)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = list({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    found = {r.node: r.root for r in graph.components(links).collect()}
    want = brute_components(fps)
    groups = [found.get(f, f) for f in signed]
    assert len({*zip(groups, want)}) == len(set(groups)) == len(set(want))


def test_components_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_decontaminate(spark, docs, no_docs):
    texts = [r.text for r in docs.where("doc_id < 20").orderBy("doc_id").collect() if r.text]
    items = [(1, " ".join(texts[1].split()[2:14])), (2, "a b"), (10, texts[4]), (3, None), (4, "!!"), (None, texts[8])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for number, text in items:
        words = plain_words((text or "").encode())
        size = min(10, len(words))
        for p in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[p : p + size]), set()).add(number)
    want = []
    for r in docs.collect():
        words, hit, found = plain_words((r.text or "").encode()), set(), set()
        for size in {len(w) for w in windows}:
            for p in range(len(words) - size + 1):
                if tuple(words[p : p + size]) in windows:
                    hit.update(range(p, p + size))
                    found |= windows[tuple(words[p : p + size])]
        names = sorted(str(x) for x in found if x is not None)
        want.append((r.doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontaminate.contamination(docs, bench).collect()]
    assert by_text(got) == by_text(want)
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_toxicity(spark, no_docs):
    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = rng.choices(plain, k=30) + (["nasty", "vileword"] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "nasty vileword here")]
    labels += [(0, 1, None), (None, 1, 1), (1, 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, known).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    held = [i for i in range(400) if got.held_out[i]]
    assert all(got.predicted[i] == (i % 8 == 0) for i in held)
    assert got.predicted[1000] == got.predicted[1001] == 0
    kept = toxicity.accepted(docs, known)
    assert kept.columns == docs.columns and kept.count() == (got.predicted == 0).sum()
    assert toxicity.scores(no_docs, known).count() == 0
    assert set(r.predicted for r in toxicity.scores(docs, known.limit(0)).collect()) == {0}


def test_toxicity_blocks_are_exact(spark):
    """The bounded search finds the k nearest of all examples."""
    rng = np.random.default_rng(0)
    vocabulary = {(f"t{i}".encode(), 1): i for i in range(40)}
    examples = [
        (i, int(i % 3 == 0), [(int(t), int(rng.integers(1, 4))) for t in sorted(set(rng.integers(0, 40, 6)))])
        for i in range(500)
    ]
    index = toxicity._index(vocabulary, rng.random(40) + 0.5, examples, np.ones(2), 0.3)
    dense = np.zeros((len(index.ids), 40))
    for t in range(40):
        for b in range(index.bound.shape[1]):
            s, e = index.begin[t, b], index.begin[t, b + 1]
            dense[index.place[s:e] + b * toxicity.BLOCK, t] = index.value[s:e]
    for _ in range(30):
        terms = np.unique(rng.integers(0, 40, 5))
        weights = toxicity.unit(rng.random(len(terms)))
        _, scores = index.nearest(terms, weights)
        assert np.allclose(scores, np.sort(dense[:, terms] @ weights)[::-1][: len(scores)])


def test_knn(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 6))
    base[50:90] = base[50]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6)]
    rows += [(250, [1.0, 2.0]), (300, [2.0, -1.0]), (None, [0.0] * 6), rows[0], (350, [])]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>")
    ints = table.select(
        table.vec_id.alias("id"), knn.quantized(table.v).alias("v"))
    got = [tuple(r) for r in knn.nearest(ints, ints.where("id % 50 = 0")).collect()]
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and i not in (200, 201, 202, 203)}
    want = []
    for q in (x for x in good if x % 50 == 0):
        scored = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert knn.nearest(ints.limit(0), ints.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi </s> \\ [INST]"), (1, 1, "assistant", "[/INST]\\l \\b <s>"), (1, 2, "system", None),
            (1, 3, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 5, "user", "[ROLE] é 🙂")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(chat.threads(given)).collect()
    for r in made:
        want = sorted(((t, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id), key=lambda x: x[0])
        assert chat.read_back(r.formatted) == [(ro, x) for _, ro, x in want]
        spans = [chat.unescaped(r.formatted[m.start : m.stop]) for m in r["mask"]]
        assert spans == [x for _, ro, x in want if ro == "assistant"]
    assert len(made) == 3
    assert chat.format_conversations(chat.threads(given.limit(0))).count() == 0


def test_chat_trees(spark):
    """The branch of the greatest score, ties to the longer one; cycles and lost parents do no harm."""
    rows = [(1, 1, None, 1.0), (1, 2, 1, 0.5), (1, 3, 1, 2.0), (1, 4, 2, 1.0), (1, 5, 4, 1.0), (1, 6, 3, None),
            (2, 1, 2, 9.0), (2, 2, 1, 9.0), (3, 1, 77, 1.0)]
    rows += [(4, i, i - 1 if i else None, 0.0) for i in range(40)]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, score double")
    best = {(r.conv_id, r.branch): (r.leaf, r.depth, r.total) for r in chat.best_branches(nodes, 2).collect()}
    assert best == {(1, 1): (5, 4, 3.5), (1, 2): (6, 3, 3.0), (3, 1): (1, 1, 1.0), (4, 1): (39, 40, 0.0)}
    chain = chat.branch_nodes(nodes, chat.best_branches(nodes)).where("conv_id = 4").collect()
    assert sorted((r.up, r.node) for r in chain) == [(i, 39 - i) for i in range(40)]


def test_extract(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>'</script></head><body>"
        "<nav><ul><li>Home</ul></nav><div class='cookie-notice'>Cookies</div><article><h1>A &amp; B</h1>"
        "<p>One <b>bold</b>ly\n  said<p>Two<div class='comments'><p>nope</div><form><input>f</form></article>"
        "<aside>x</aside><footer>&copy;</footer></body></html>"
    )
    plain = "<div id=menu>" + "<a href=x>l</a>" * 9 + "</div><div><p>" + "long words here " * 30 + "<p>ok.</div>"
    rows = [(1, "u", page, 0), (2, "u", None, 0), (3, None, "", 0), (4, "u", plain, 0), (4, "u", plain, 0), (5, "u", "<p>a<", 0)]
    got = extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == "A & B One boldly said Two" and texts[2] == texts[3] == ""
    assert texts[4] == ("long words here " * 30).strip() + " ok."
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)


def test_extract_reads_on_after_marked_sections():
    """No '<![' ends a page, whatever follows it."""
    for page, want in [
        ("<p>one</p><![foo[x]]><p>two</p>", "one two"),
        ("<p>one</p><![ endif]--><p>two</p>", "one two"),
        ("<p>one</p><![endif]--><p>two</p><p>a[1]></p>", "one two a[1]>"),
        ("<p>a <![1] b</p><p>c</p>", "a c"),
        ("<p>one</p><![CDATA[x]]><p>two</p><![", "one two <!["),
    ]:
        assert extract.main_text(page) == want, page


STORY = "".join(f"<p>Part {i}. {'some more words here ' * 20}</p>" for i in range(8))


def test_extract_teasers_are_not_the_story():
    """A marked article does not stand in for the page's regions of content."""
    teaser = "<article class=teaser><h3>Elsewhere</h3><p>A short teaser.</p><a href=x>More</a></article>"
    for page in (
        f"<body><div class=story><h1>Title</h1>{STORY}</div>{teaser}</body>",
        f"<body>{teaser}{teaser}<div><h1>Title</h1>{STORY}</div></body>",
        f"<body><main><div><h1>Title</h1>{STORY}</div>{teaser}</main></body>",
    ):
        text = extract.main_text(page)
        assert all(f"Part {i}." in text for i in range(8)) and "Title" in text and "teaser" not in text
    listed = f"<article>{STORY}{'<p>Short line.</p>' * 20}{STORY}</article>"
    assert extract.main_text(listed).count("Short line.") == 20


def test_extract_wrappers_are_read():
    """Names drop boilerplate, not what wraps the story or a part of a token."""
    menu = "<nav>" + "<a href=x>Menu entry</a>" * 9 + "</nav>"
    for page in (
        f"<div class='content has-sidebar'><article>{STORY}</article></div><div class='sidebar'><p>Menu</p></div>",
        f"<div class='page-with-navbar'>{menu}<div>{STORY}</div></div>",
        f"<form id=page>{menu}<article>{STORY}</article><button>Menu</button></form>",
        f"<form>{menu}<div>{STORY}</div></form>",
        f"<div class='header'><article>{STORY}</article></div><div class='cookie-notice'>Menu</div>",
        f"<html><head><title>Menu</title><body>{menu}<div>{STORY}</div>",
    ):
        text = extract.main_text(page)
        assert all(f"Part {i}." in text for i in range(8)) and "Menu" not in text, page[:60]
    named = f"<article><h2 class='section-header'>Head</h2>{STORY}<p class='share-price'>Price</p></article>"
    assert extract.main_text(named).startswith("Head Part 0.") and extract.main_text(named).endswith("Price")
    beside = f"<article><h1>One</h1>{STORY}<div class='comments'>{STORY.replace('Part', 'Reply') * 2}</div></article>"
    assert "Reply" not in extract.main_text(beside)
    assert extract.main_text(f"<article><h1>One</h1></article><footer>{'Long words. ' * 9}</footer>") == "One"


def test_packing(docs, no_docs):
    rows = packing.pack(docs, vocabulary_path(), size=64, with_ids=True).toPandas()
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 64
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    want = sorted(
        np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        for r in docs.where("doc_id != 2 and doc_id is not null").collect()
    )
    mine = rows[(rows.doc_id != 2) & rows.doc_id.notna()].sort_values(["doc_id", "piece"])
    assert sorted(b"".join(map(bytes, g.ids)) for _, g in mine.groupby("doc_id")) == want
    assert all(zlib.crc32(bytes(i)) == c for i, c in zip(rows.ids, rows.ids_crc32))
    assert packing.pack(no_docs, vocabulary_path()).count() == 0


def test_packing_ids_of_added_tokens():
    """Ids are those of the tokenizer as its file makes it."""
    from tokenizers import Tokenizer

    from ctxlens.llm.tokens import Encoder

    untouched = Tokenizer.from_file(vocabulary_path())
    texts = ["ab <|endoftext|> cd", "a<|endoftext|>, b. c\n<|endoftext|>", "plain words, here.", "<|endoftext|>", "<|endof text|>"]
    want = [np.array(untouched.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Encoder(vocabulary_path()).ids(texts) == want
    assert len(want[0]) == 4 * 4


def test_packing_encodes_new_words_many_at_a_time():
    """the tokenizer is not called with a text of its own for every new word."""
    import pyarrow as pa

    from ctxlens.llm.tokens import Encoder

    texts = [" ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}{end}" for k in range(676)) for end in ("", ",", ".\nThen", "$")]
    texts += [None, "", " ", "a ", "a  b", "a \u00a0b\u3000 c\n d", "x\x1c y", "<|endoftext|> z", "it's, we're.", "中文 中文, a\u0120b"]
    mine, plain = Encoder(vocabulary_path()), Encoder(vocabulary_path())
    handed, call = [], mine._encoded
    mine._encoded = lambda some: handed.extend(some) or call(some)
    want = plain._encoded([t or "" for t in texts])
    assert mine.ids(pa.array(texts)) == want == mine.ids(texts)
    assert len(handed) < 300


def test_packing_tokenizes_batches_together(monkeypatch):
    """rows stay with their batches, whatever is tokenized at once."""
    import pyarrow as pa

    batches = [pa.record_batch({"text": pa.array(t, pa.string())}) for t in (["a b", None], [], ["c, d", "a b"], ["e"])]
    for limit in (1, 12, 1 << 20):
        monkeypatch.setattr(packing, "AT_ONCE", limit)
        got = list(packing._tokenized(iter(batches), vocabulary_path()))
        assert [len(ids) for _, ids in got] == [2, 0, 2, 1] and got[2][1][1] == got[0][1][0] and got[0][1][1] == b""


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    histogram = {n: int(rng.integers(50, 500)) for n in range(1, 1025)}
    plan = packing.solve(histogram)
    held = {}
    for times, inside in plan:
        assert sum(inside) <= 1024
        for n in inside:
            held[n] = held.get(n, 0) + times
    assert held == histogram
    total = sum(n * k for n, k in histogram.items())
    assert sum(t for t, _ in plan) <= 1.01 * total / 1024 + 1


def test_licenses(spark, docs):
    mit = licenses.TEMPLATES["mit"].split()
    rng = random.Random(0)
    filler = lambda n: [rng.choice("abcdefghij") * 3 for _ in range(n)]
    near = mit[:40] + ["changed"] + mit[41:]
    rows = [(1, " ".join(filler(500) + mit + filler(40))), (2, " ".join(mit[:30])), (3, " ".join(filler(77) + near)),
            (4, "x Released under the MIT License. y"), (5, None), (6, ""), (None, "Licensed under CC BY-NC 4.0")]
    got = {(r.doc_id, r.license): r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "mit"), (3, "mit"), (4, "mit-notice"), (None, "cc-by-nc-4.0-notice")}
    assert got[1, "mit"].containment == 1.0 and 0.8 <= got[3, "mit"].containment < 1.0
    assert licenses.scanned(docs, {"none": "!!"}).count() == 0


def test_licenses_of_the_common_families(spark):
    """Whole published texts and usual notices, alone and inside other words."""
    whole = [n for n in licenses.TEMPLATES if n.endswith("-text")]
    assert {"gpl-2.0-text", "lgpl-2.1-text", "mpl-2.0-text", "cc0-1.0-text", "unlicense-text", "bsd-3-clause-text"} <= set(whole)
    worded = {
        "mit-notice": "You may use it under the terms of the MIT license today",
        "gpl-2.0-notice": "distributed under the GNU General Public License v2.0 as is",
        "gpl-2.0": "under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or any later version",
        "lgpl-2.1-notice": "under the terms of the GNU Lesser General Public License, version 2.1",
        "agpl-3.0-notice": "It is licensed under the AGPLv3.",
        "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "cc0-1.0-notice": "dedicated under CC0 1.0 Universal",
        "cc-by-4.0-notice": "licensed under a Creative Commons Attribution 4.0 International License",
        "cc-by-sa-4.0-notice": "available under the CC BY-SA 4.0 license",
        "unlicense-notice": "released under the Unlicense",
        "bsd-notice": "see it under a BSD-style license",
    }
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice("abcdefghij") * 3 for _ in range(n))
    rows = [(i, f"{filler(333)} {licenses.TEMPLATES[n]} {filler(50)}") for i, n in enumerate(whole)]
    rows += [(100 + i, f"{filler(61)} {t} {filler(9)}") for i, t in enumerate(worded.values())]
    got = {(r.doc_id, r.license): r.containment for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got.get((i, n)) == 1.0 for i, n in enumerate(whole))
    assert {k: v for k, v in got.items() if k[0] >= 100} == {(100 + i, n): 1.0 for i, n in enumerate(worded)}


def test_url_lists(spark):
    day = lambda n: date(2024, 1, n)
    entries = [("bad.com", day(3), True), ("bad.com", day(8), False), ("bad.com", day(8), False), ("x.bad.com", day(5), True),
               (None, day(1), True), ("a.org", None, True), ("a.org", day(1), None)]
    captures = [(1, "http://u:p@www.BAD.com:80/x?y#z", day(3)), (2, "https://bad.com", day(2)), (3, "https://x.bad.com/", day(9)),
                (4, "https://bad.com/", day(8)), (5, None, day(4)), (6, "nonsense", day(4)), (7, "http://bad.com", None), (1, "http://bad.com", day(7))]
    got = url_lists.judged(
        spark.createDataFrame(captures, "capture_id long, url string, day date"),
        spark.createDataFrame(entries, "domain string, day date, listed boolean"),
    ).collect()
    found = sorted((r.capture_id, r.listed, r.domain or "", str(r.since)) for r in got)
    assert found == [(1, True, "bad.com", "2024-01-03")] * 2 + [(2, False, "", "None"), (3, True, "x.bad.com", "2024-01-05"),
        (4, False, "", "None"), (5, False, "", "None"), (6, False, "", "None"), (7, False, "", "None")]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == before.columns, name
        docs = docs.checkpoint()
        assert 0 < docs.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(whole.select("doc_id", "piece", "ids_crc32").collect()) == sorted(packed.select("doc_id", "piece", "ids_crc32").collect())
