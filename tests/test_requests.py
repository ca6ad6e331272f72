import json
import random

import pytest
from pyspark.sql import functions as F

from ctxlens.functions import variants as V
from ctxlens.operators import cache_plan, messages, policy, reuse, sessions
from ctxlens.operators.skeletons import HEADER
from ctxlens.plans.compaction import Options, compact
from ctxlens.sources.request_log import parse_bodies, read_log

PLACE = {"messages": "/v1/messages", "chat": "/v1/chat/completions", "responses": "/v1/responses"}


def log(spark, *bodies, api="messages"):
    rows = [
        (str(i), PLACE[api], b if isinstance(b, str) else json.dumps(b))
        for i, b in enumerate(bodies)
    ]
    df = spark.createDataFrame(rows, "request_id string, endpoint string, body string")
    return parse_bodies(df.withColumn("ts", F.timestamp_seconds(F.col("request_id").cast("int") * 60)))


def plans(spark, *bodies):
    rows = cache_plan.plan_requests(messages.requests(log(spark, *bodies)))
    return [r for r in rows.orderBy(F.col("request_id").cast("int")).collect()]


def user(content, role="user"):
    return {"role": role, "content": content}


def turns(n, wrap=lambda t: t):
    return [user(wrap(f"turn {i}")) for i in range(n)]


MARK = {"cache_control": {"type": "ephemeral"}}
LONG = {"cache_control": {"type": "ephemeral", "ttl": "1h"}}


def block(text, **more):
    return {"type": "text", "text": text, **more}


def test_parsing_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "log.json").write_text(
        '{"request_id":"1","endpoint":"/v1/messages","body":{"model":"m"}}\n'
        '{"request_id":"2","endpoint":"/v1/messages","body":"{\\"model\\":\\"n\\"}"}\n'
        '{"request_id":"3","endpoint":"/v1/messages","body":""}\nnot json\n'
        '{"request_id":"5","endpoint":"/v1/messages","body":"[1]"}\n'
    )
    rows = parse_bodies(read_log(spark, str(tmp_path))).select("request_id", "corrupt").collect()
    assert sorted((r.request_id or "-", r.corrupt) for r in rows) == [
        ("-", True), ("1", False), ("2", False), ("3", False), ("5", True)]


def test_plan_cases(spark):
    tool = {"name": "Read"}
    cases = [
        ({"messages": turns(3), "tools": [tool, tool]}, 2, 0, [(0, 1, 0), (2, 0, 0)]),
        ({"messages": turns(3), "tools": []}, 1, 0, [(2, 0, 0)]),
        ({"messages": turns(3), "tools": [{**tool, **MARK}]}, 1, 0, [(0, 0, 0), (2, 0, 0)]),
        ({"messages": turns(3), "system": "s"}, 2, 0, [(1, 0, 0), (2, 0, 0)]),
        ({"messages": turns(3), "system": "  "}, 1, 0, [(2, 0, 0)]),
        ({"messages": turns(3), "system": [block("a"), block("b")]}, 2, 0, [(1, 1, 0), (2, 0, 0)]),
        ({"messages": turns(2), "system": "s"}, 0, -1, []),
        ({"messages": turns(6)}, 1, 3, [(2, 3, 0)]),
        ({"messages": turns(5, lambda t: [block(t), {"type": "image"}])}, 1, 2, [(2, 2, 0)]),
        ({"messages": turns(5, lambda t: [block(t, **MARK)])}, 0, -1, [(2, i, 0) for i in range(4)]),
        ({"messages": turns(5, lambda t: [{"type": "image"}])}, 0, -1, []),
        ({"messages": [None, "string", 42, {"role": "user"}]}, 0, -1, []),
        ({}, 0, -1, []),
        ({"messages": [user(""), user("b"), user("c")]}, 0, -1, []),
    ]
    got = plans(spark, *[c[0] for c in cases])
    for (body, n, end, marks), row in zip(cases, got):
        assert (row.breakpoints, row.prefix_end_index) == (n, end), body
        assert [(m.section, m.idx, m.sub_idx) for m in row.markers] == marks, body


def test_budget_and_lifetimes(spark):
    some = turns(8, lambda t: [block(t)])
    for m in some[:3]:
        m["content"][0].update(MARK)
    trimmed = turns(5, lambda t: [block(t)])
    for m in trimmed[:3]:
        m["content"][0].update(MARK)
    rows = plans(
        spark,
        {"system": "s", "messages": some, "tools": [{"name": "R"}]},
        {"system": [block("s", **MARK)], "messages": trimmed, "tools": [{"name": "R", **MARK}]},
        {"system": [block("a"), block("b", **LONG)], "messages": turns(5), "tools": [{"name": "R"}]},
        {"system": [block("a", **MARK), block("b", **LONG)], "messages": turns(2)},
    )
    assert [(r.breakpoints, len(r.markers)) for r in rows] == [(1, 4), (0, 4), (2, 3), (0, 2)]
    assert [m.ttl for m in rows[2].markers] == ["1h", "1h", None]
    assert [m.ttl for m in rows[3].markers] == ["1h", "1h"]


def test_sessions_and_estimate(spark):
    head = [user("Let's fix it"), user("Sure", "assistant")]
    rows = plans(
        spark, {"messages": head + [user("3")]}, {"messages": head + turns(4)},
        {"messages": [user("x" * 4000), user("b"), user("c")]}, {"messages": turns(2)},
    )
    assert rows[0].session_id == rows[1].session_id != rows[2].session_id
    assert rows[2].cached_tokens_estimate == 1000 and rows[3].session_id is None
    planned = cache_plan.plan_requests(messages.requests(
        log(spark, *[{"messages": turns(4)}] * 2, {"messages": head + turns(2)})))
    stats = sessions.cache_stats(planned).first()
    assert (stats.sessions_seen, stats.requests_with_breakpoints) == (2, 3)


def test_marking_again_adds_no_tool_or_system_marker(spark):
    body = {"system": "s", "messages": turns(8), "tools": [{"name": "R"}], "max_tokens": 5}
    once = cache_plan.marked_bodies(cache_plan.plan_requests(messages.requests(log(spark, body))))
    text = once.select(F.col("body").cast("string")).first()[0]
    assert json.loads(text)["max_tokens"] == 5 and text.count("ephemeral") == 3
    again = plans(spark, text)[0]
    assert again.breakpoints == 0 and len(again.markers) == 3


CODE = "def f(a):\n    b = a\n    c = b\n    return c\n"
SKELETON = HEADER + "\ndef f(a):\n    ..."


def fenced(name, code=CODE):
    return f"# File: {name}\n```python\n{code}```\n"


def compacted(spark, body, api="chat", **options):
    run = compact(log(spark, body, api=api), Options(**options))
    out = run.rewritten_bodies().select(F.col("body").cast("string")).first()[0]
    return json.loads(out), run


def test_plain_chat(spark):
    text = "Fix payment.py\n" + fenced("payment.py") + fenced("utils.py")
    body, run = compacted(spark, {"messages": [user(text), user(text, "tool")]})
    first = body["messages"][0]["content"]
    assert first == text[: text.rindex(CODE)] + SKELETON + "\n```\n"
    assert body["messages"][1]["content"] == text
    row = run.request_metrics().first()
    assert row.original_tokens - row.compressed_tokens == len(text) // 4 - len(first) // 4
    counts = run.block_counts().first()
    assert (counts.total_blocks, counts.skeletonized_blocks) == (2, 1)


def test_parts_are_scanned_one_by_one(spark):
    content = [block("Fix payment.py"), block(fenced("utils.py")), {"type": "image", "x": 1}]
    body, run = compacted(spark, {"messages": [user(content)]})
    assert body["messages"][0]["content"][1]["text"] == fenced("utils.py", SKELETON + "\n")
    assert body["messages"][0]["content"][2] == {"type": "image", "x": 1}


def reads(second="payment.py", as_list=False):
    result = [block(CODE), {"type": "image"}] if as_list else CODE
    return [
        user("look"),
        user([{"type": "tool_use", "id": "t1", "name": "R", "input": {"file_path": "payment.py"}}], "assistant"),
        user([{"type": "tool_result", "tool_use_id": "t1", "content": result}]),
        user("again", "assistant"),
        user([{"type": "tool_use", "id": "t2", "name": "R", "input": {"path": second}}], "assistant"),
        user([{"type": "tool_result", "tool_use_id": "t2", "content": result}]),
    ]


@pytest.mark.parametrize("as_list", [False, True])
def test_stale_read_is_replaced(spark, as_list):
    body, _ = compacted(spark, {"messages": reads(as_list=as_list)})
    old = body["messages"][2]["content"][0]["content"]
    new = body["messages"][5]["content"][0]["content"]
    shown = old[0]["text"] if as_list else old
    assert shown.endswith(SKELETON) and "payment.py" in shown
    assert (new[0]["text"] if as_list else new) == CODE
    if as_list:
        assert old[1] == {"type": "image"}


def test_reads_that_stay(spark):
    for body, api, options in [
        ({"messages": reads("other.py")}, "chat", {}),
        ({"messages": reads()}, "chat", {"keep_last_reads": 2}),
        ({"messages": reads()}, "chat", {"compress_with_tools": False}),
        ({"messages": reads()}, "chat", {"passthrough": True}),
        ({"messages": reads()}, "messages", {}),
    ]:
        out, _ = compacted(spark, body, api, **options)
        assert out["messages"][2]["content"][0]["content"] == CODE
    out, _ = compacted(spark, {"messages": reads()}, "messages", plan_cache=False)
    assert out["messages"][2]["content"][0]["content"] != CODE


def test_prefix_is_stable_across_turns(spark):
    first = [user("fix a.py"), user(fenced("b.py"), "assistant"), user("what"), user("ok"), user("go")]
    one, _ = compacted(spark, {"messages": first}, "messages")
    two, _ = compacted(spark, {"messages": first + [user("x"), user(fenced("c.py"))]}, "messages")
    same = [m["content"] for m in one["messages"][:2]]
    assert same == [m["content"] for m in two["messages"][:2]] == ["fix a.py", fenced("b.py")]
    assert two["messages"][6]["content"] == fenced("c.py", SKELETON + "\n")


def test_system_prompt_makes_a_file_active(spark):
    items = [user(fenced("payment.py"))]
    out, _ = compacted(spark, {"system": [block("Focus on"), block("payment.py")], "messages": items}, "messages")
    assert out["messages"][0]["content"] == fenced("payment.py")


def test_responses(spark):
    call = {"type": "function_call", "name": "f", "arguments": "{}", "call_id": "1"}
    body, run = compacted(
        spark, {"input": [user(fenced("u.py")), call, {"type": "reasoning", "content": "abcdefgh"}, user("fix a.py")]},
        "responses")
    assert body["input"][1] == call and body["input"][3]["content"] == "fix a.py"
    assert body["input"][0]["content"] == fenced("u.py", SKELETON + "\n")
    row = run.request_metrics().first()
    assert row.original_tokens == 3 + 8 + len(fenced("u.py")) // 4 + 2
    assert row.compressed_tokens == 3 + 12 + len(body["input"][0]["content"]) // 4 + 2 + 2
    text, _ = compacted(spark, {"input": fenced("u.py")}, "responses")
    assert text["input"] == fenced("u.py", SKELETON + "\n")
    typed = {"input": [user([{"type": "input_text", "text": "x"}]), user(fenced("u.py"))]}
    assert compacted(spark, typed, "responses")[0] == typed


def test_tool_detection(spark):
    bodies = [
        {"tools": [{}]}, {"functions": [{}]}, {"tool_choice": "auto"}, {"tool_choice": "none"},
        {"tools": []}, {"messages": [user("x", "tool")]}, {"messages": reads()}, {"messages": turns(1)},
    ]
    rows = policy.request_policy(messages.requests(log(spark, *bodies, api="chat")))
    got = [r.has_tools for r in rows.orderBy("request_id").collect()]
    assert got == [True, True, True, False, False, True, True, False]


def test_truthy(spark):
    df = spark.createDataFrame([(x,) for x in ["0", "[]", "{}", '""', "null", "false", "1", "[0]", '"a"']], "j string")
    got = [r[0] for r in df.select(V.truthy(F.parse_json("j"))).collect()]
    assert got == [False] * 6 + [True] * 3


def test_prefix_reuse_of_changed_sessions(spark):
    """Random sessions whose requests grow, repeat, are cut or edited, against a walk over the messages."""
    rng = random.Random(9)
    msgs, order = [], []
    for s in ("a", "b", "hot", None):
        texts = []
        for turn in range(30 if s == "hot" else 6):
            for _ in range(rng.randrange(4)):
                texts.append((rng.choice(("user", "assistant", None)), rng.choice(("x", "xy" * 40, "", None))))
            if texts and rng.random() < 0.3:
                texts[rng.randrange(len(texts))] = ("user", f"changed {turn}")
            if rng.random() < 0.1:
                texts = texts[: len(texts) // 2]
            r = len(order)
            order.append((r, s, rng.choice((turn, turn, 0)) if s == "b" else turn))
            msgs += [(r, i, *m) for i, m in enumerate(texts)]
    held = {}
    for r, i, role, text in msgs:
        held.setdefault(r, []).append((role, text))
    want = []
    for s in ("a", "b", "hot"):
        mine = sorted((t, r) for r, k, t in order if k == s)
        for n, (_, r) in enumerate(mine, 1):
            if r not in held:
                continue
            before = mine[n - 2][1] if n > 1 and mine[n - 2][1] in held else None
            old = held.get(before, [])
            common = next((i for i, (x, y) in enumerate(zip(held[r], old)) if x != y), min(len(held[r]), len(old)))  # noqa: B905
            covered = len(old) - 2 if len(old) >= 3 and old[-3][1] else 0
            reused = min(common, covered)
            tokens = sum(len(t or "") for _, t in held[r][:reused]) // 4
            want.append((r, s, n, before, len(held[r]), common, reused, tokens))
    got = reuse.prefix_reuse(
        spark.createDataFrame(msgs, "request_id long, msg_idx int, role string, text string"),
        spark.createDataFrame(order, "request_id long, session_id string, s long").withColumn("ts", F.timestamp_seconds("s")),
    )
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda w: w[0])
    assert sum(w[6] for w in want) > 20
