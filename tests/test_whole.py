"""Nothing is cut or dropped: whole texts, malformed vectors, null sessions, late rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ctxlens.operators import cache_plan, ranking, sessions
from ctxlens.operators.ranking import Query
from ctxlens.sources.corpus import _arrow_uri, list_files, read_code
from ctxlens.streaming import totals


def _timed(spark, rows):
    df = spark.createDataFrame(rows, "k string, id long, s long")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_relevance_sees_the_whole_file(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "x\n" * 3000 + "needle"), ("r", "b.py", "x"), ("r", "c.py", " \n")],
        "repo string, path string, content string",
    )
    rows = ranking.keyword_scores(ranking.summaries(files), [Query(1, "needle")]).collect()
    assert {r.path: r.score for r in rows} == {"a.py": 1.0, "b.py": 0.0}


@pytest.mark.parametrize("size", [None, 3])
def test_malformed_vectors_stay_with_a_null_score(spark, size):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0, 0.0]), (2, [1.0, None, 0.0]), (3, [1.0]), (4, None), (5, [0.0, 0.0, 0.0]),
         (6, [-1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0, 2.0])],
        "path int, embedding array<float>",
    )
    query = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    got = {r.path: r.score for r in ranking.cosine_scores(df, query, size).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: None, 5: 0.0, 6: 0.0, 7: None}


def test_requests_without_a_session_have_turn_zero(spark):
    df = _timed(spark, [("a", 1, 0), (None, 2, 0), ("a", 3, 5), (None, 4, 9)])
    got = {r.id: (r.run, r.turn_count) for r in sessions.turn_counts(df, "k", "ts", "id", 10).collect()}
    assert got[2] == got[4] == (None, 0)
    assert got[1][1] == 1 and got[3][1] == 2


def test_sessions_of_one_long_preamble_differ(spark):
    rows = [(r, 0, "user", "p" * 600 + r) for r in "ab"]
    msgs = spark.createDataFrame(rows, "request_id string, msg_idx int, role string, text string")
    whole = {r.session_id for r in cache_plan.flat_fingerprint(msgs).collect()}
    cut = {r.session_id for r in cache_plan.flat_fingerprint(msgs, 512).collect()}
    assert len(whole) == 2 and len(cut) == 1


def test_stream_sessions_take_late_rows_and_repeated_batches(spark, tmp_path):
    folder = str(tmp_path / "runs")
    write = totals.session_writer(folder, "k", "ts", 60)
    batches = [
        [("a", 1, 1000), ("a", 2, 1100), ("b", 3, 1000)],
        [("a", 4, 1050), ("a", 5, 5000)],  # the late row joins two runs
        [("b", 6, 939), ("b", 7, 879)],
    ]
    for i, rows in enumerate(batches):
        write(_timed(spark, rows), i)
    write(_timed(spark, batches[1]), 1)
    got = sorted(
        (r.k, r.a, r.b, r.turn_count)
        for r in totals.session_totals(spark, folder, "k", 60)
        .select("k", F.unix_seconds("first_seen").alias("a"), F.unix_seconds("last_seen").alias("b"), "turn_count")
        .collect()
    )
    assert got == [("a", 1000, 1100, 3), ("a", 5000, 5000, 1), ("b", 879, 939, 2), ("b", 1000, 1000, 1)]


def test_stream_totals_take_late_rows(spark, tmp_path):
    folder = str(tmp_path / "totals")
    write = totals.totals_writer(folder, "k")
    for i, rows in enumerate([[("a", 1, 0), ("a", 2, 90_000)], [("a", 3, 60)]]):
        write(
            _timed(spark, rows).withColumns(
                {"original_tokens": F.col("id") * 10, "compressed_tokens": F.col("id"), "cost_saved": F.lit(0.5)}
            ),
            i,
        )
    got = sorted(
        (r.w, r.requests, r.tokens_saved)
        for r in totals.windowed_totals(spark, folder, "k")
        .select(F.unix_seconds("window_start").alias("w"), "requests", "tokens_saved")
        .collect()
    )
    assert got == [(0, 2, 36), (90_000, 1, 18)]


def test_every_file_of_a_tree_is_read_once(spark, tmp_path):
    names = ["a.py", "_b.py", "__init__.py", "_p=1/a.py", "_q=2.py", "_c/d.py", ".e/f.py", "_metadata.py", "_metadata/z.py", "g/_h=1/_i.py"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    got = sorted((r.path, r.content) for r in read_code(spark, str(tmp_path), "r").collect())
    assert got == sorted((n, n) for n in names)


def test_files_are_listed_level_by_level(spark, tmp_path):
    names = ["a.py", "d/e/f/g.txt", "d/.h/i", "_x=1/__init__.py", "d/e/k.py"]
    for i, n in enumerate(names):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * i)
    (tmp_path / "empty").mkdir()
    (tmp_path / "bad.py").write_bytes(b"\xff")
    for root in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        code = {r.path for r in read_code(spark, root, "r").collect()}
        assert code == {"a.py", "_x=1/__init__.py", "d/e/k.py"}
    assert {r.path for r in read_code(spark, str(tmp_path), "r", hidden=False).collect()} == {"d/e/k.py"}  # Spark reads no empty files
    (tmp_path / "d/loop").symlink_to(tmp_path)
    got = {r.path: r["size"] for r in list_files(spark, str(tmp_path)).collect()}
    assert got == {n: i for i, n in enumerate(names)} | {"bad.py": 1}
    assert _arrow_uri("s3a://bucket/code") == "s3://bucket/code" and _arrow_uri("hdfs://n/x") == "hdfs://n/x"
