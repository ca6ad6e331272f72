"""Logs as they come: repeated and missing request ids, lines that are no JSON."""

import json

import pytest
from pyspark.sql import functions as F

from ctxlens.plans.compaction import Options, compact
from ctxlens.sources.request_log import parse_bodies, read_log

CODE = "def f(a):\n    b = a\n    c = b\n    return c\n"


def chat(text):
    return json.dumps({"messages": [{"role": "user", "content": text}]})


def fenced(name):
    return f"# File: {name}\n```python\n{CODE}```\n"


def parsed(spark, *rows):
    df = spark.createDataFrame(
        [(i, f"/v1/{place}", body) for i, place, body in rows],
        "request_id string, endpoint string, body string",
    )
    return parse_bodies(df)


def test_repeated_and_missing_ids_stay_single_rows(spark):
    run = compact(parsed(
        spark,
        ("a", "chat/completions", chat("x" * 8)), ("a", "chat/completions", chat("x" * 8)),
        (None, "chat/completions", chat(fenced("u.py"))), (None, "chat/completions", chat("x" * 40)),
        ("a", "messages/count_tokens", chat("x" * 400)),
    ))
    rows = run.request_metrics().collect()
    assert sorted((r.request_id or "", r.original_tokens) for r in rows) == sorted(
        [("a", 9), ("a", 9), ("", 7 + len(fenced("u.py")) // 4), ("", 17)]
    )
    bodies = [(r.request_id, r.body) for r in run.rewritten_bodies().select(
        "request_id", F.col("body").cast("string").alias("body")).collect()]
    assert len(bodies) == 5 and sum("structural skeleton" in b for _, b in bodies) == 1
    assert [tuple(r) for r in run.block_counts().collect()] == [(None, 1, 1)]


def test_lines_without_json_keep_their_text(spark, tmp_path):
    (tmp_path / "x.json").write_text('no json\n{"request_id": "r", "body": "{broken"}\n{"request_id": "s", "body": {"a": 1}}\n')
    rows = parse_bodies(read_log(spark, str(tmp_path))).select("request_id", "corrupt", "raw_body").collect()
    assert sorted(map(tuple, rows), key=str) == [
        ("r", True, "{broken"), ("s", False, None), (None, True, "no json")
    ]


def corpus(spark, *rows):
    return spark.createDataFrame([("demo", p, c) for p, c in rows], "repo string, path string, content string")


@pytest.mark.parametrize("threshold, reduced", [(0.5, 0), (1.1, 1)])
def test_files_that_suit_the_question_stay_whole(spark, threshold, reduced):
    body = chat("refund rounding again\n" + fenced("utils.py"))
    files = corpus(spark, ("lib/utils.py", "x " * 3000 + "refunds and Rounding"), ("lib/b.py", "nothing"))
    run = compact(parsed(spark, ("a", "chat/completions", body)), Options(boost_threshold=threshold), files)
    assert run.block_counts().first().skeletonized_blocks == reduced
