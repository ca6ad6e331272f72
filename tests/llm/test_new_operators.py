"""Hard negatives, spelling variants and personal data against brute force and on odd rows."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxlens.llm import extract, knn, negatives, private_data, spelling, url_lists
from ctxlens.llm.catalog import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, found string, word int"
VECTORS = "id long, label string, v array<long>, anchor int, slot string"


# Hard negatives.

def brute_negatives(rows, anchors, k=5, percent=80):
    rows = [(i, y, v) for i, y, v in set(rows) if i is not None and y is not None and v is not None]
    out = []
    for anchor, label, vector in {r for r in rows if r in set(anchors)}:
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, v, strict=True)), i, y)
            for i, y, v in rows if i != anchor and len(v) == len(vector)
        )
        for p, number, _ in [s for s in scored if s[2] == label][:k]:
            some = [s for s in scored if s[2] != label and percent * -p <= 100 * -s[0] <= 100 * -p]
            out += [(anchor, number, rank, n, -p, -s) for rank, (s, n, _) in enumerate(some[:k], 1)]
    return sorted(out)


def mined(spark, rows, anchors):
    data = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    ask = spark.createDataFrame([(*r, 1, "x") for r in anchors], VECTORS)
    got = negatives.hard_negatives(data, ask)
    assert got.columns == [c.split()[0] for c in negatives.MINED.split(", ")]
    return sorted(map(tuple, got.collect()))


def made_vectors(n, seed, width=3, spread=9):
    rng = random.Random(seed)
    return [(i, rng.choice("abb"), tuple(rng.randint(0, spread) for _ in range(width))) for i in range(n)]


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SPLIT", 40)  # many splits and blocks
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    rows = made_vectors(150, 1) + [(1000 + i, "b", (5, 5, 5)) for i in range(60)]  # copies, ties
    rows += [(2000 + i, "a", (-i, 3, 1)) for i in range(20)]
    asked = [r for r in rows if r[0] % 10 == 0]
    got = mined(spark, rows, asked)
    assert got == brute_negatives(rows, asked)
    assert len({r[:2] for r in got}) > 50 and max(r[2] for r in got) == 5


def test_hard_negatives_of_odd_rows(spark):
    rows = [
        (1, "a", (2, 2)), (2, "a", (2, 1)), (3, "b", (2, 1)), (3, "b", (2, 1)), (4, "b", (1, 2)), (5, None, (2, 1)),
        (None, "b", (2, 1)), (6, "b", None), (7, "b", (3, 3, 3)), (8, "a", (3, 3, 3)), (9, "a", ()), (10, "b", ()), (12, "a", ()),
        (13, "c", (-5, -5)), (14, "c", (5, 5)), (15, "z", (4, 4)), (2, "b", (1, 1)), (16, "b", (3, 3, 2)), (17, "a", (0, 0, 9)),
    ]
    assert mined(spark, rows, rows) == brute_negatives(rows, rows)
    assert mined(spark, [], []) == [] and mined(spark, rows, []) == [] and mined(spark, [], rows) == []


def test_hard_negatives_beyond_doubles(spark):
    big = 2**30
    rows = [(1, "a", (big, big + 1)), (2, "a", (big, big)), (3, "b", (big, big - 1)), (4, "b", (big, big - 2)), (5, "b", (big + 1, big))]
    assert mined(spark, rows, rows) == brute_negatives(rows, rows)
    a = np.array([[2**62, 2**62], [-(2**62), -(2**62)], [1, 0]])
    assert negatives.products(a, a).tolist() == [
        [2**63 - 1, -(2**63 - 1), 2**62], [-(2**63 - 1), 2**63 - 1, -(2**62)], [2**62, -(2**62), 1]
    ]


def test_lower_limits():
    for score in range(-30, 200):
        low = negatives.lower_limit(score)
        assert 100 * low >= 80 * score > 100 * (low - 1)


# Spelling variants.

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, factor=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= factor * counts[w]:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out, key=str)


def brute_words(rows, every):
    counts = Counter()
    for number, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{number}:{run}".encode())
            if number is not None and every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def made_words(seed, n, letters="abcé"):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.choice((5, 6, 6, 7, 7, 8, 9, 14)))) for _ in range(n)]


def test_acceptor():
    rng = random.Random(5)
    for _ in range(80):
        words = sorted({"".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(rng.randint(0, 40))})
        made = [tuple(sorted(p)) for p in spelling.Acceptor(words).near()]
        assert sorted(made) == [(a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b)]
    # Equal rests share their states.
    assert len(set(map(id, spelling.Acceptor(["ax", "bx"]).arcs[0].values()))) == 1
    long = "x" * 20_000
    made = spelling.Acceptor(sorted([long, long[1:], "y" + long[1:]])).near()
    assert {tuple(sorted(p)) for p in made} == {
        (long[1:], long), (long, "y" + long[1:]), (long[1:], "y" + long[1:])
    }


@pytest.mark.parametrize("group", [12, 100_000])
def test_variants(spark, group):
    counts = {w: random.Random(w).choice((5, 26, 131, 700)) for w in made_words(2, 500) if len(w) >= 6}
    # A long shared beginning, so that groups are halved several times.
    counts |= {"zusammen" + w: 7 + i for i, w in enumerate(sorted({w[:4] for w in made_words(3, 300)}))}
    words = spark.createDataFrame([*counts.items(), (None, 9), ("nothing", None)], "word string, n long")
    got = spelling.variants(words, group=group).collect()
    assert sorted(map(tuple, got), key=str) == brute_variants(counts)
    assert max(r.n_near for r in got) > 3 and sum(r.root != (r.form or r.word) for r in got) > 3


def test_vocabulary(spark):
    rng = random.Random(4)
    words = made_words(7, 60) + ["Größer", "ÉTUDES", "ÉTudes", "abc÷def×", "x" * 3000]
    rows = [(i, " ".join(rng.choices(words, k=60)) + "-Abcdef1abcdef_ŝabcdef") for i in range(40)]
    rows += [(None, rows[0][1]), (7, None), (8, ""), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x", 2) for r in rows], DOCS)
    for every in (0, 3, 199):
        got = {r.word: r.n for r in spelling.vocabulary(docs, every).collect()}
        assert got == brute_words(rows, every)
    empty = docs.limit(0)
    assert spelling.variants(spelling.vocabulary(empty, 199)).count() == 0


# Personal data.

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PLAIN = {
    "email": EMAIL,
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub(r"\D", "", m[0], flags=re.ASCII)
            luhn = 0
            for i, d in enumerate(reversed(digits)):
                luhn += sum(map(int, str(int(d) * (1 + i % 2))))
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans():
    rng = random.Random(6)
    bits = ["a", "b.c", "@", ".", "-", " ", "+", "1", "25", "255", "256", "4111 1111 1111 1111", "(5) ", "é", "_", "%", "00", "@x.y",
            "+1 (743) 555-3824", "4316522678525456", "9.8.7.6", "\n", "٣"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        got = [s[:3] for s in private_data.found_in(text) if s[4]]
        assert got == brute_base(text), text


@pytest.mark.parametrize("text, kind, value", [
    ("x ‹jane.doe [at] example [dot] com› y", "email", "jane.doe@example.com"),
    ("x ‹jane at example dot com› y", "email", "jane@example.com"),
    ("x ‹jane(AT)mail{dot}example(dot)org›, y", "email", "jane@mail.example.org"),
    ("x ‹john.doe at example.com› y", "email", "john.doe@example.com"),
    ("x ‹john @ example . com› y", "email", "john@example.com"),
    ("x ‹jane&#64;example&#x2e;com› y", "email", "jane@example.com"),
    ("x ‹jane＠example．com› y", "email", "jane@example.com"),
    ("x ‹jаne@exаmple.com› y", "email", "jane@example.com"),
    ("x ‹j​ane@exam­ple.com› y", "email", "jane@example.com"),
    ("écrire à ‹jean point dupont arobase exemple point fr› svp", "email", "jean.dupont@exemple.fr"),
    ("x ‹four one one one one one one one one one one one one one one one› y", "card", "4111111111111111"),
    ("12 ‹quatre un un un un un un un un un un un un un un un› y", "card", "4111111111111111"),
    ("x ‹４１１１ １１１１ １１１１ １１１１› y", "card", "4111 1111 1111 1111"),
    ("x ‹4l11 11l1 1111 1111› y", "card", "4111 1111 1111 1111"),
    ("x ‹plus one five five five one two three double four six seven› y", "phone", "+15551234467"),
    ("x ‹+١ ٧٤٣ ٥٥٥ ٣٨٢٤› y", "phone", "+1 743 555 3824"),
    ("x ‹192[.]168[.]1[.]1› y", "ip", "192.168.1.1"),
    ("x ‹one nine two dot one six eight dot one dot one› y", "ip", "192.168.1.1"),
])
def test_disguises(text, kind, value):
    before, inside, after = re.split("[‹›]", text)
    source = before + inside + after
    got = [s for s in private_data.found_in(source) if not s[4]]
    assert got == [(kind, len(before), len(before) + len(inside), value, False)]


@pytest.mark.parametrize("text", [
    "we met at noon. Com and go at 3.5 dot", "meet us at example.com", "one two three four five six seven eight nine zero",
    "apples @ 1.99 each", "state-at-rest", "the point at issue. De facto", "+1 (743) 555-3824 un deux", "é 4111 1111 1111 1112",
])
def test_clean_texts(text):
    assert [s for s in private_data.found_in(text) if not s[4]] == []


def test_base_stays():
    got = private_data.found_in("jоhn@example.com, a@b.com and a [at] b.com")
    assert [s[:3] for s in got if s[4]] == brute_base("jоhn@example.com, a@b.com and a [at] b.com")
    assert [s[3] for s in got] == ["john@example.com", "hn@example.com", "a@b.com", "a@b.com"]


def test_time_grows_with_the_text():
    for unit in ("a", "1", "1.", "+1(", "a.b@", "at ", "one ", "[at] ", "dot ", "а", "@ ", "@a. ", "%40", "O0", "_at_", "<", " "):
        spent = time.process_time()
        private_data.found_in(unit * (300_000 // len(unit)))
        assert time.process_time() - spent < 3, unit


def test_identifiers_of_rows(spark):
    texts = ["a@b.com", None, "", "a (at) b.com " * 3, "é" * 100_000 + " +1 743 555 3824"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    docs = spark.createDataFrame([(*r, "en", "s", 1, "x", 2) for r in rows], DOCS)
    got = [(r.doc_id, [tuple(s) for s in r.found]) for r in private_data.identifiers(docs).collect()]
    want = [(i, private_data.found_in(t) if t else []) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert private_data.identifiers(docs.limit(0)).count() == 0
    masked = private_data.redacted(docs.withColumn("_text", F.lit("kept")))
    assert masked.columns == [*docs.columns, "_text"]
    by = {r.doc_id: r.text for r in masked.collect() if r.doc_id is not None}
    assert by == {0: "[EMAIL]", 1: None, 2: "", 3: "[EMAIL] " * 3, 4: "é" * 100_000 + " [PHONE]"}


def test_all_rows_of_the_query(spark):
    from ctxlens.llm.catalog import CATALOG

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in CATALOG.queries["op13_private_data"](spark, folder).collect()}
    assert len(got) == len(docs)
    for d in docs:
        base = brute_base(d.text or "")
        row = got[d.doc_id]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(
            sum(k == kind for k, *_ in base) for kind in PLAIN
        )
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))
    words = brute_words([(d.doc_id, d.text) for d in docs], 199)
    found = CATALOG.queries["op12_spelling_variants"](spark, folder).collect()
    assert sorted(map(tuple, found), key=str) == brute_variants(words)



# Blocks of queries, and pages that take long to read.

def test_queries_are_dealt_evenly_whatever_their_ids(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 100)
    rng = np.random.default_rng(1)
    rows = [(50 * i, rng.integers(0, 9, 2).tolist() if i % 4 else [1, 2, i % 7]) for i in range(4000)]
    rows += [(-1, [7] * 5), (-2, [8] * 5)]  # a length that gets no pivot
    made, keep = {}, knn.stage
    monkeypatch.setattr(knn, "stage", lambda df, name: made.setdefault(name, keep(df, name)))
    data = spark.createDataFrame(rows, "id long, v array<long>")
    got = knn.nearest(data.where("size(v) <> 2 or id % 1000 = 0 or id < 0"), data)
    blocks = Counter(r.block for r in made["routes"].select("block").collect())
    assert len(blocks) >= 35 and max(blocks.values()) <= 200
    assert {r.vec_id for r in got.where("query_id = -1").collect()} == {-2}


def test_long_and_odd_pages_take_time_in_proportion():
    for unit in ("<b>", "<i>", "<p>", "<div>", "</b>", "<a ", "<!--", "</", "<ul><li>", "<table><tr><td>", "<![a", "<?", "<a b='"):
        for page in (unit * 60_000, unit * 30_000 + "<p>" * 30_000, "<b>" * 30_000 + unit * 30_000):
            spent = time.process_time()
            extract.main_text(page)
            assert time.process_time() - spent < 5, unit


@pytest.mark.parametrize("start, item, stop, end", [("<ul>", "<li>", "</li>", "</ul>"), ("<table>", "<tr><td>", "</td></tr>", "</table>")])
def test_lists_and_tables_inside_an_unmarked_story_stay(start, item, stop, end):
    story = "<p>" + "A paragraph of the story that goes on and on for a while. " * 3 + "</p>"
    menu = start + "".join(f"{item}<a href=x>menu {i}</a>{stop}" for i in range(8)) + end
    listed = start + "".join(f"{item}entry {i}{stop}" for i in range(12)) + end
    page = f"<body>{menu}<div><h1>Title</h1>{story * 4}{listed}{story * 4}{menu}{story * 4}</div>"
    text = extract.main_text(page)
    assert "entry 0 entry 1" in text and "entry 11" in text and "menu" not in text


def test_text_behind_the_last_tag_stays():
    assert extract.main_text("<p>one</p>two &amp; <three") == "one two & <three"
    assert extract.main_text("no tag &lt; here") == "no tag < here"


def test_hosts_of_odd_urls(spark):
    urls = {
        "http://[2001:db8::1]:80/x": "[2001:db8::1]", "http://a@b@c.com/": "c.com", "http://u:p@Ex.COM.:8080?q@r": "ex.com",
        "https://x.org\\@evil.net/": "x.org", "http://10.1.1.1/": "10.1.1.1", "mailto:a@b.c": None, "http:///x": None,
        "http://": None, "": None, None: None, "http://a.b#c@d": "a.b", "http://[::1": None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_lists.host(F.col("url")).alias("host"))
    assert {r.url: r.host for r in rows.collect()} == urls
    names = spark.createDataFrame([("10.1.1.1",), ("[2001:db8::1]",), ("a.b.c",), ("a",)], "n string")
    got = [r.d for r in names.select(url_lists.domains(F.col("n")).alias("d")).collect()]
    assert got == [["10.1.1.1"], ["[2001:db8::1]"], ["a.b.c", "b.c"], ["a"]]


def test_list_entries_are_named_as_hosts_are(spark):
    day = date(2024, 1, 2)
    captures = spark.createDataFrame(
        [(1, "http://www.example.com/", day), (2, "http://10.1.1.1/", day), (3, "http://[2001:db8::1]/", day)], "capture_id long, url string, day date"
    )
    entries = spark.createDataFrame(
        [("Example.com.", day, True), ("1.1.1", day, True), ("[2001:DB8::1]", day, True), ("..", day, True)], "domain string, day date, listed boolean"
    )
    got = {r.capture_id: r.domain for r in url_lists.judged(captures, entries).collect()}
    assert got == {1: "example.com", 2: None, 3: "[2001:db8::1]"}


def test_sequences_are_rebuilt_from_the_pipeline(spark, tmp_path):
    """The last stage's rows hold the token ids of every sequence, in place."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(["one two three " * 600, "", None, "a b", "é " * 2000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    tokenizer = Tokenizer.from_file(vocabulary_path())
    sequences, texts = {}, {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.offset == len(sequences.setdefault(r.sequence_id, []))
        sequences[r.sequence_id] += ids
        texts.setdefault(r.doc_id, []).append((r.start, ids))
    assert all(len(s) <= 1024 for s in sequences.values())
    for i, text, *_ in rows:
        whole = [x for _, ids in sorted(texts[i]) for x in ids]
        assert whole == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
