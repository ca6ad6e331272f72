import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.functions import formats, text


def _eval(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


@pytest.mark.parametrize(
    "prose, found",
    [
        ("Fix payment.py", ["payment.py"]),
        ("Fix payment.py.", []),
        ("payment.py?", []),
        ("a.py b.py", ["a.py"]),
        ("a.py, b.py", ["a.py", "b.py"]),
        ("see `src/Utils.PY` and 'src/util.py'", ["util.py"]),
        ("## File: lib/X.txt", ["x.txt"]),
        ("# module: core", ["core"]),
        ("x\\y\\Z.cpp:", ["z.cpp"]),
        ("größe.py\r\nnext", ["größe.py"]),
    ],
)
def test_referenced_files(texts, prose, found):
    assert _eval(texts(prose), text.referenced_files(F.col("text"))) == [found]


def test_code_inside_blocks_is_not_a_reference(texts):
    df = texts("look at a.py\n```\nuse b.py here\n```\n")
    assert _eval(df, text.referenced_files(F.col("text"))) == [["a.py"]]


ANNOTATIONS = [
    ("# File: a.py\n```python\nx\n```", "a.py", "python"),
    ("// file: b.ts\n```\nx\n```", "b.ts", "typescript"),
    ("/* MODULE: c.h */\n```\nx\n```", "c.h", "c"),
    ("<!-- file: d.html -->\n```\nx\n```", "d.html", ""),
    ("```\n# File: e.go\nx\n```", "e.go", "go"),
    ("```\nx\n```", None, ""),
    ("# File: f.kt\n```\nx\n```", "f.kt", ""),
]


@pytest.mark.parametrize("source, name, language", ANNOTATIONS)
def test_block_annotations(texts, source, name, language):
    (blocks,) = _eval(texts(source), text.code_blocks(F.col("text")))
    assert [(b.filename, b.language) for b in blocks] == [(name, language)]


def test_splice_is_by_position(texts):
    source = "x = 1\n```\nx = 1\n```\nx = 1\n# File: a.py\n```\n```\n```js\nx = 1\n```"
    new = F.create_map(
        F.lit(0), F.struct(F.lit("new\n").alias("code"), F.lit(6).alias("old_chars"))
    )
    (out,) = _eval(texts(source), text.splice_blocks(F.col("text"), new))
    assert out == source.replace("```\nx = 1\n```", "```\nnew\n```", 1)


def test_summary_rules(texts):
    rows = [
        "a\n\n  b \r\nc\rd\x0be f",
        "\n".join(f"l{i}" for i in range(40)),
        "x" * 5000,
        " \n\t\n",
    ]
    for chars, lines in ((2048, 20), (None, None), (100, None), (None, 3)):
        want = []
        for r in rows:
            head = r.replace("\r\n", "\n").replace("\r", "\n")[:chars].splitlines()[:lines]
            want.append(" ".join(x.strip() for x in head if x.strip()))
        assert _eval(texts(*rows), text.file_summary(F.col("text"), chars, lines)) == want


def test_tool_input_paths(spark):
    rows = [
        ({"path": "a.py", "file_path": "b.py"}, "b.py"),
        ({"file_path": "", "file": "c"}, "c"),
        ({"cmd": "cat src/d.go now"}, "src/d.go"),
        ({"cmd": "ls"}, None),
        ({}, None),
    ]
    df = spark.createDataFrame([(r,) for r, _ in rows], "m map<string,string>")
    got = [r[0] for r in df.select(text.file_from_tool_input(F.col("m"))).collect()]
    assert got == [w for _, w in rows]


def test_formats(spark):
    df = spark.range(1).select(
        formats.tokens_text(F.lit(999)), formats.tokens_text(F.lit(1500)),
        formats.tokens_text(F.lit(2_500_000)), formats.money_text(F.lit(2.456)),
        formats.duration_text(F.lit(3725.9)), formats.bar_text(F.lit(0.25), 4),
    )
    assert list(df.first()) == ["999", "1.5k", "2.5M", "$2.46", "01:02:05", "█░░░ 25.0%"]


WORDS = st.lists(
    st.sampled_from(["a.py", "b/c.js", "d.", " ", "\n", "`", "```", "py", "\n```\n", "# File: z.c\n", "é.go", ",", "x"]),
    max_size=14,
).map("".join)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORDS, min_size=20, max_size=40))
def test_patterns_agree_with_python(texts, samples):
    """The Java patterns find what the same patterns find under Python's re."""
    block = re.compile(
        r"(?:(?:#|//)\s*(?:File|file|MODULE|module):\s*(\S+)\n|"
        r"(?:/\*\s*(?:File|file|MODULE|module):\s*(\S+)\s*\*/\n|<!--\s*file:\s*(\S+)\s*-->\n))?"
        r"```(\w*)\n(.*?)```",
        re.DOTALL,
    )
    exts = "|".join(e[1:] for e in fv.CODE_EXTENSIONS)
    path = re.compile(
        r"(?:^|[\s`\"'\(])([.\w/\\-]+\.(?:" + exts + r"))(?:[\s`\"'\),:;]|$)", re.MULTILINE
    )
    df = texts(*samples)
    codes = F.transform(text.code_blocks(F.col("text")), lambda b: b.code)
    refs = text.path_references(text.without_code_blocks(F.col("text")))
    assert _eval(df, codes) == [[m.group(5) for m in block.finditer(s)] for s in samples]
    assert _eval(df, refs) == [path.findall(block.sub("", s)) for s in samples]
