import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.operators import skeletons as sk
from ctxlens.operators.skeletons import HEADER, line_stats, skeleton_of, skeletons

PY = '''
import os

LIMIT = 3

class Shop(Base):
    """Doc."""
    rate: float = 1.0
    name = "x"
    print("gone")

    @property
    def total(self) -> int:
        """Sum."""
        return 1

    async def pay(self): return 2

    class Inner:
        pass

def f(a, *, b=2):
    """Doc f."""
    def g():
        return a
    return g

if __name__ == "__main__":
    f(1)
'''


def _py(**options):
    return skeleton_of(PY, "python", **options)[0]


def test_python_bodies_go_and_structure_stays():
    out = _py()
    assert out.startswith(HEADER + "\nimport os\nLIMIT = 3\n")
    assert "def total(self) -> int:\n        ..." in out
    assert "async def pay(self):" in out and "return" not in out
    assert "class Inner:\n        ..." in out
    assert "rate: float = 1.0" in out and "name = 'x'" in out
    assert "gone" not in out and "Doc" not in out
    assert "f(1)" in out


def test_python_options():
    assert '"""Doc."""' in _py(keep_docstrings=True)
    assert '"""Doc f."""' in _py(keep_docstrings=True)
    assert "rate" not in _py(keep_class_attrs=False)


@pytest.mark.parametrize("bad", ["def foo(:", "x = '\0'", "(" * 5000])
def test_unreadable_python_is_unchanged(bad):
    assert skeleton_of(bad, "py")[0] == bad
    assert skeleton_of(bad, "")[3] is False


def test_indented_python_is_read():
    assert skeleton_of("    def f():\n        return 1\n", "python")[3] is True


JS = "import x\nfunction f(a) {\n  if (a) { return '}'; }\n  return 2;\n}\nconst k = 1;\n"


@pytest.mark.parametrize("name", ["javascript", "TS", "go", "rust", "java", "cs"])
def test_brace_languages(name):
    out, before, after, done = skeleton_of(JS, name)
    assert out == HEADER + "\nimport x\nfunction f(a) { ... \nconst k = 1;\n"
    assert (before, after, done) == (6, 4, True)


def test_brace_rules():
    def cut(code):
        return skeleton_of(code, "c")[0].split("\n", 1)[1]

    assert cut("int f() {\n  char *s = \"\\\"{\";\n}\nend") == "int f() { ... \nend"
    assert cut("int f() {\n  open {\n") == "int f() { ... "
    assert cut("no braces\nat all") == "no braces\nat all"
    go = "int early() {\n 1\n}\nfunc late(a int) int {\n 2\n}\n"
    assert cut(go) == "int early() {\n 1\n}\nfunc late(a int) int { ... \n"
    assert cut("fn a() -> u8 {\n 1\n}\npub fn b() {\n 2\n}\n") == "fn a() -> u8 { ... \npub fn b() { ... \n"


def test_unknown_language_is_unchanged():
    assert skeleton_of("def f():\n  return 1", "cobol") == ("def f():\n  return 1", 2, 2, False)


def test_job_reads_equal_code_once(spark):
    rows = [("python", "def f():\n    return 1\n")] * 300 + [("python", "x = 1"), ("go", "x = 1")]
    df = spark.createDataFrame(rows, "language string, code string")
    done = skeletons(df)
    assert done.count() == 3
    stats = {(r.language, r.was_compressed) for r in line_stats(done).collect()}
    assert ("python", True) in stats and ("go", False) in stats
    smaller = skeletons(df, require_smaller=True).where("was_compressed").count()
    assert smaller == 0


def test_hash_is_the_join_key(spark):
    df = spark.createDataFrame([("python", "a = 1")], "language string, code string")
    row = skeletons(df).select((F.col("code_hash") == F.sha2("code", 256)).alias("ok")).first()
    assert row.ok


def _by_patterns(code):
    """Brace skeletons by trying the three patterns at every line start."""
    searched, out, pos = code[: code.rfind("{") + 1], [], 0
    patterns = [fv.GO_SIGNATURE, fv.RUST_SIGNATURE, fv.GENERIC_SIGNATURE]
    while pos < len(searched):
        found = None
        for pattern in patterns:
            found = re.compile(pattern).match(searched, pos) or re.compile("^" + pattern, re.M).search(searched, pos)
            if found:
                break
        if not found:
            break
        out += [code[pos : found.end()], fv.BODY_PLACEHOLDER]
        pos = sk._body_end(code, found.end() - 1)
    return "".join(out) + code[pos:]


PIECES = [
    "func ", "func", "fn ", "pub ", "pub\n", "f", "x1", "(", ")", "()", "(a, b)", "{", "}", " ", "\n", "\n  ", ":", " -> ",
    "->", "int", "[]*", "'", '"', "=", "if", "\t", "func (r *T) m(a) e {", "pub fn g(a) -> i32 {", "static int k(int a) : T {", "\x1f",
]


def test_brace_skeletons_are_those_of_the_patterns():
    pick, reduced = random.Random(7), 0
    for _ in range(6000):
        code = "".join(pick.choice(PIECES) for _ in range(pick.randint(1, 28)))
        want = _by_patterns(code)
        assert sk._bare_braces(code) == want, code
        reduced += want != code
    assert reduced > 500


@pytest.mark.parametrize("line", [
    "plain words of a text\n", "func a(\n", "func (\n", "fn a(\n", "a(\n", "f() : a\n", "f() -> a\n", "\n", "{ a b\n", "f(a) {\n", "pub\n", "\"{\n",
])
def test_long_texts_take_time_in_proportion(line):
    code = line * (1_000_000 // len(line)) + ") {"
    begun = time.process_time()
    sk._bare_braces(code)
    assert time.process_time() - begun < 10


def test_kept_skeletons_are_not_made_again(spark, tmp_path, monkeypatch):
    codes = [("python", f"def f{i}():\n    return {i}\n") for i in range(6)] + [("go", "x = 1"), ("python", "def f(:"), (None, "x"), ("python", None)]
    df = spark.createDataFrame(codes + codes[:3], "language string, code string")
    columns = ["language", "code_hash", "skeleton", "original_lines", "skeleton_lines", "was_compressed"]
    rows = lambda done: sorted(map(tuple, done.select(*columns).collect()), key=str)
    folder = f"{tmp_path}/store"
    known = df.where(F.col("language").isNotNull())
    first = rows(sk.stored_skeletons(known.limit(3), folder))
    made, make = [], sk.skeletons
    monkeypatch.setattr(sk, "skeletons", lambda codes, **o: made.append(codes.count()) or make(codes, **o))
    assert rows(sk.stored_skeletons(known, folder)) == rows(make(known)) and made == [5]
    assert rows(sk.stored_skeletons(known, folder)) == rows(make(known)) and made == [5]
    assert first == rows(sk.stored_skeletons(known.limit(3), folder)) and made == [5]
    # Other options are other skeletons; a part that was added twice counts once.
    other = sk.stored_skeletons(known, folder, keep_docstrings=True, header="# h")
    assert rows(other) == rows(make(known, keep_docstrings=True, header="# h")) and made == [5, 8]
    parts = sk.Parts(spark, folder)
    parts.append(parts.read())
    assert rows(sk.stored_skeletons(known, folder)) == rows(make(known)) and made == [5, 8]
    assert sk.stored_skeletons(known.limit(0), folder).count() == 0
