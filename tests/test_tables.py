"""Skew-safe operators against brute force, with one key holding most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ctxlens.functions.tokens import bpe_tokens, heuristic_tokens
from ctxlens.operators import messages, accounting, cache_plan, imports, ordered, ranking, sessions, tool_reads
from ctxlens.operators.ranking import Query
from ctxlens.sources.commit_log import read_commit_log
from ctxlens.sources.corpus import module_name, read_code
from ctxlens.sources.pricing import default_pricing
from ctxlens.sources.sinks import append_by_day


def _hot(rng, n):
    return ["hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}" for _ in range(n)]


@pytest.mark.parametrize("span", [1, 7, 1 << 40])
@pytest.mark.parametrize("keep", [1, 2])
def test_stale_results(spark, span, keep):
    rng = random.Random(span + keep)
    rows = []
    for pos, req in enumerate(_hot(rng, 500)):
        kind = rng.choice(["use", "result"])
        file = rng.choice(["a", "b", None]) if kind == "use" else None
        rows.append((req, pos, kind, rng.choice(["1", "2", None]), file))
    by_id, reads, note = {}, defaultdict(list), {}
    for req, pos, kind, tool, file in rows:
        if kind == "use" and file:
            by_id[req, tool] = note[req, tool] = file
        elif kind == "result" and (req, tool) in by_id:
            reads[req, by_id[req, tool]].append((pos, tool))
    want = {(req, p, note[req, t]) for (req, _), rs in reads.items() for p, t in rs[:-keep]}
    df = spark.createDataFrame(rows, "request_id string, pos bigint, kind string, tool_id string, file string")
    got = tool_reads.stale_results(df, keep, span).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_keep_last_must_be_positive(spark):
    with pytest.raises(ValueError):
        tool_reads.stale_reads(spark.createDataFrame([], "request_id int, pos int, file int"), 0)


@pytest.mark.parametrize("gap", [1, 300])
def test_turns_and_runs(spark, gap):
    rng = random.Random(gap)
    rows = [
        (k, round(rng.random() * gap * 60, rng.choice([0, 6])) - 20, i)
        for i, k in enumerate(_hot(rng, 600))
    ]
    rows += [("edge", 1000.0, 900), ("edge", 1000.0 + gap, 901), ("edge", 1000.0 + 2 * gap + 1e-6, 902)]
    df = spark.createDataFrame(rows, "k string, s double, id int").withColumn(
        "ts", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("bigint")))
    want, last, runs = {}, {}, {}
    for k, us, i in sorted((k, round(s * 1e6), i) for k, s, i in rows):
        if k not in last or us - last[k] > gap * 10**6:
            runs[k] = runs.get(k, 0) + 1
            want[k, runs[k]] = []
        want[k, runs[k]].append(i)
        last[k] = us
    got = {(r.id): (r.run, r.turn_count) for r in sessions.turn_counts(df, "k", "ts", "id", gap).collect()}
    assert got == {i: (run, n + 1) for (_, run), ids in want.items() for n, i in enumerate(ids)}
    totals = {(r.k, r.run): r.turn_count for r in sessions.session_runs(df, "k", "ts", gap).collect()}
    assert totals == {k: len(v) for k, v in want.items()}


def test_prefix_estimate(spark):
    rng = random.Random(1)
    chars = {f"r{i}": [rng.randrange(100) for _ in range(n)] for i, n in enumerate([1, 2, 3, 4, 200])}
    chars |= {"empty": [5, 0, 7, 9], "empty opening": [0, 3, 3]}
    rows = [(r, i, c) for r, cs in chars.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "request_id string, msg_idx int, n_chars bigint")
    got = {r.request_id: (r.prefix_end_index, r.cached_tokens_estimate) for r in cache_plan.prefix_estimate(df).collect()}
    assert got == {
        r: ((len(c) - 3 if c[-3] else -1, sum(c[:-2]) // 4) if len(c) > 2 else (-1, 0)) for r, c in chars.items()
    }


def test_costs_and_price_fallback(spark):
    rows = [("gpt-4o", 1000, 400), ("nobody", 1000, 0), ("default", 0, 0)]
    df = spark.createDataFrame(rows, "model string, original_tokens bigint, compressed_tokens bigint")
    got = {r.model: r for r in accounting.request_costs(df, default_pricing(spark)).collect()}
    assert got["gpt-4o"].cost_saved == pytest.approx(600 / 1e6 * 2.5)
    assert got["nobody"].original_cost == pytest.approx(0.003) and got["default"].compression_ratio == 0.0
    bare = default_pricing(spark).where("model = 'gpt-4o'")
    assert accounting.request_costs(df, bare).where("model = 'nobody'").first().original_cost == pytest.approx(0.003)


def test_token_counters(spark, tmp_path):
    import base64

    vocab = tmp_path / "bytes.tiktoken"
    vocab.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    df = spark.createDataFrame([("abcdefgh<|endoftext|>",), ("",), (None,)], "t string")
    exact = [r[0] for r in df.select(bpe_tokens(str(vocab), r"[\s\S]+")(F.col("t"))).collect()]
    assert exact == [21, 0, 0]
    assert [r[0] for r in df.select(heuristic_tokens(F.col("t"))).collect()] == [5, 0, 0]


FILES = {
    "a.py": "import pkg.sub\nimport os\n",
    "pkg/__init__.py": "",
    "pkg/sub.py": "from . import x\nfrom .other import y\n",
    "pkg/other.py": "import pkg.missing.deep\nfrom ..a import z\n",
    "bad.py": "def broken(:\n",
}


def test_import_graph_from_files(spark, tmp_path):
    for name, code in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(code)
    (tmp_path / "latin.py").write_bytes(b"x = '\xff'")
    (tmp_path / "note.txt").write_text("import a")
    files = read_code(spark, str(tmp_path), "r")
    assert {(r.path, r.module) for r in files.collect()} == {
        ("a.py", "a"), ("pkg/__init__.py", "pkg"), ("pkg/sub.py", "pkg.sub"),
        ("pkg/other.py", "pkg.other"), ("bad.py", "bad")}
    edges = imports.import_graph(files)
    assert {(r.src, r.dst) for r in edges.collect()} == {
        ("a.py", "pkg/sub.py"), ("pkg/sub.py", "pkg/other.py"),
        ("pkg/other.py", "pkg/__init__.py"), ("pkg/other.py", "a.py")}
    start = spark.createDataFrame([("r", "a.py"), ("r", "gone.py")], "repo string, start string")
    near = {(r.node, r.steps, r.relation) for r in imports.neighbourhood(start, edges, 2).collect()}
    assert near == {
        ("pkg/sub.py", 1, "dependency"), ("pkg/other.py", 2, "dependency"),
        ("pkg/other.py", 1, "dependent"), ("pkg/sub.py", 2, "dependent")}
    deep = imports.reachable(start, edges, 4)
    assert {r.node for r in deep.collect()} == {"pkg/sub.py", "pkg/other.py", "pkg/__init__.py"}


def test_module_names(spark):
    df = spark.createDataFrame([("a/b.c/d.py",), ("__init__.py",)], "p string")
    assert [r[0] for r in df.select(module_name(F.col("p"))).collect()] == ["a.b.c.d", "__init__"]


def test_commit_log_and_recency(spark, tmp_path):
    (tmp_path / "log").write_text(
        "COMMIT|1700000000\n\na.py\nb.py\n\nCOMMIT|bad\n\nc.py\n\nCOMMIT|1702592000\n\na.py\n")
    commits = read_commit_log(spark, str(tmp_path), "r")
    assert sorted((r.path, r.commit_ts.year) for r in commits.collect()) == [("a.py", 2023)] * 2 + [("b.py", 2023)]
    got = {r.path: r.score for r in ranking.recency(commits, "2023-12-14 22:13:20").collect()}
    assert got == {"a.py": pytest.approx(1.0), "b.py": pytest.approx(0.5)}


def test_ranking_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["pay", "cart", "user", "log", "tax"]
    files = {f"d/{i}.py": " ".join(rng.choices(words, k=2)) if i % 3 else "zzz" for i in range(40)}
    age = {p: rng.randrange(90) for p in list(files)[::2]}
    age["gone.py"] = 0
    links = {(rng.choice(list(files)), rng.choice(list(files))) for _ in range(60)}
    links = {(a, b) for a, b in links if a != b}
    queries = [Query(1, "pay tax."), Query(2, "nothing here"), Query(3, "user", "d/7.py")]
    code = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo string, path string, content string")
    edges = spark.createDataFrame([("r", a, b) for a, b in links], "repo string, src string, dst string")
    recency = spark.createDataFrame([("r", p, 0.5 ** (d / 30)) for p, d in age.items()], "repo string, path string, score double")
    for k in (3, 60):
        got = ranking.assemble_context(code, edges, recency, queries, k=k).collect()
        for q in queries:
            ws = set(q.text.lower().replace(".", " ").split())
            sem = {p: sum(w in f"{p.split('/')[-1]} {t}".lower() for w in ws) / len(ws) for p, t in files.items()}
            target = q.target or min(sem, key=lambda p: (-sem[p], p))
            part = {b: 0.8 for a, b in links if a == target} | {a: 0.5 for a, b in links if b == target}
            part[target] = 1.0
            total = {
                p: 0.4 * sem.get(p, 0) + 0.4 * part.get(p, 0) + 0.2 * (0.5 ** (age[p] / 30) if p in age else 0)
                for p in set(files) | set(age)}
            want = sorted(total, key=lambda p: (-round(total[p], 12), p))[:k]
            mine = [r.path for r in sorted(got, key=lambda r: r.rank_no) if r.query_id == q.query_id]
            assert mine == want, (k, q)


def test_daily_facts(spark, tmp_path):
    df = spark.range(4).withColumn("ts", F.timestamp_seconds(F.col("id") * 50_000))
    append_by_day(df, f"{tmp_path}/facts")
    append_by_day(df, f"{tmp_path}/facts")
    assert spark.read.parquet(f"{tmp_path}/facts").groupBy("day").count().count() == 2


def test_plans_reduce_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "f")], "request_id string, pos bigint, file string")

    def plan(x):
        return x._jdf.queryExecution().executedPlan().toString()

    assert "WindowGroupLimit" in plan(tool_reads.nth_latest(df, ["request_id"], "pos", 3, "p"))
    assert "partial_max" in plan(tool_reads.stale_reads(df))
    assert "WindowGroupLimit" in plan(accounting.recent_by(df, "request_id", "pos", "file"))
    assert "Cartesian" not in plan(tool_reads.stale_reads(df))


def test_last_user_text_without_code(spark):
    rows = [("r", 0, "user", "first", False), ("r", 1, "user", "see ```py\nx = 1\n``` here", False), ("r", 2, "assistant", "no", False)]
    df = spark.createDataFrame(rows, "request_id string, msg_idx int, role string, text string, detect_only boolean")
    assert messages.last_user_text(df).first().text == "see  here"


def test_few_files_per_day(spark, tmp_path):
    df = spark.range(4000).repartition(40).withColumn("ts", F.timestamp_seconds(F.col("id") % 2 * 86400))
    append_by_day(df, f"{tmp_path}/facts", files_per_day=3)
    read = spark.read.parquet(f"{tmp_path}/facts")
    assert read.count() == 4000 and len(read.inputFiles()) <= 6


def test_ranks_of_hot_keys(spark):
    """Most rows share one key, and nine of ten one time stamp: ranges split them."""
    rng = random.Random(8)
    rows = [("hot" if i % 20 else f"k{i % 7}", 500 if i % 10 else rng.randrange(1000), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, id int")
    got = {r.id: r.n for r in ordered.ranks(df, ["k"], ["t", "id"], "n").collect()}
    whole = {r.id: r.n for r in ordered.ranks(df, [], ["t", "id"], "n", first=0).collect()}
    want, place = {}, {}
    for k, _, i in sorted(rows):
        want[i] = place[k] = place.get(k, 0) + 1
    assert got == want
    assert whole == {i: n for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: r[1:]))}
    ranges = ordered.ranks(df, ["k"], ["t", "id"], "n")
    assert "Window" not in ranges._jdf.queryExecution().executedPlan().toString()
    assert ordered.ranks(df.limit(0), ["k"], ["t"], "n").count() == 0
