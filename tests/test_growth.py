"""What a query holds or writes must not grow with pairs, or in one place."""

import __spark_entry__


def conversations(spark, folder, n):
    rows = [(c, t, "user", f"text {c} of {t}") for c in range(n) for t in range(4)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{folder}/conversations.parquet"
    )
    return str(folder)


def test_bodies_are_not_broadcast(spark, tmp_path):
    df = __spark_entry__.queries()["passthrough_unchanged"](spark, conversations(spark, tmp_path, 30))
    assert df.collect()[0].requests == 30 * 4 - 4  # four conversations have a body that is no JSON
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [before" in plan and "BroadcastHashJoin [before" not in plan


def test_many_small_files_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from ctxlens.sources import corpus, sinks

    monkeypatch.setattr(corpus, "NAMES_PER_TASK", 2)
    rows = [("part=1", "a"), ("part=1", "b"), ("_odd2", None), *((f"_odd{i}", f"é{i}") for i in range(3, 20))]
    made = spark.createDataFrame(rows, "folder string, value string").coalesce(1)
    assert sinks.write_texts(made, str(tmp_path)) == 19
    assert sinks.write_texts(made, str(tmp_path)) == 19  # run again
    files = corpus.read_code(spark, str(tmp_path), "demo", "part-*.txt")
    assert files.rdd.getNumPartitions() > 9  # 18 names that Spark passes over, two a task
    got = {r.path.split("/")[0]: r.content for r in files.collect()}
    assert got == {"part=1": "a\nb\n", "_odd2": "\n", **{f"_odd{i}": f"é{i}\n" for i in range(3, 20)}}


def test_names_of_a_corpus_are_not_kept_in_the_driver(spark, tmp_path):
    """Files are read by the names that tasks listed; Spark's own reader lists all files in the driver."""
    from ctxlens.sources import corpus

    (tmp_path / "root" / "_x=1").mkdir(parents=True)
    (tmp_path / "root" / ".git").mkdir()
    (tmp_path / "far").mkdir()
    where = str(tmp_path / "root")
    held = {"a.py": "a", "b.pyx": "b", "c.txt": "c", "_x=1/d.py": "d", ".git/e.py": "e", "f.py": "", "g.gz.py": "g", "_h.py": "h"}
    for name, text in held.items():
        (tmp_path / "root" / name).write_text(text)
    for name in ("i.py", "_j.py", "k.pyx"):
        (tmp_path / "far" / name).write_text(name)
    (tmp_path / "root" / "link").symlink_to(tmp_path / "far")
    files = corpus.read_code(spark, where, "demo")
    assert "binaryFile" not in files._jdf.queryExecution().toString()
    got = {r.path: r.content for r in files.collect()}
    # Behind a linked folder lies what Spark's readers see there, as ever.
    assert got == {k: v for k, v in held.items() if k.endswith(".py")} | {"link/i.py": "i.py"}
    braces = {r.path for r in corpus.read_code(spark, where, "demo", "*.{pyx,txt}").collect()}
    assert braces == {"b.pyx", "c.txt", "link/k.pyx"}
    seen = {r.path: r.content for r in corpus.read_code(spark, where, "demo", hidden=False).collect()}
    assert seen == {k: v for k, v in got.items() if not k.startswith((".git", "_h")) and v}
