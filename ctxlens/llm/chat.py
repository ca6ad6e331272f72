"""Chat formatting: reply trees to conversations in one text with a loss mask.

A reply table becomes paths by self-joins that double the distance to a known
ancestor each round; leaves are ranked by the score summed along their path, and the
chosen path of each conversation is written as one text. Control strings inside
messages are escaped, so the text can be read back turn by turn.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxlens.llm.tables import map_rows, stage

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]"]
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_CODES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {v: k for k, v in _CODES.items()}
_CODED = re.compile(r"\\[\\lb]")
_CONTROL = re.compile("(" + "|".join(map(re.escape, CONTROLS)) + ")")


def escaped(text: str) -> str:
    """No control string and no lone backslash is left; `unescaped` undoes it."""
    return _ESCAPE.sub(lambda m: _CODES[m[0]], text)


def unescaped(text: str) -> str:
    return _CODED.sub(lambda m: _PLAIN[m[0]], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """One turn in the template, and where its text begins and ends in it."""
    body = escaped(text)
    if role == "user":
        head, tail = "[INST]", "[/INST]"
    elif role == "assistant":
        head, tail = "", "</s>"
    else:
        head, tail = f"[ROLE]{escaped(role)}[/ROLE]", "[/TURN]"
    return head + body + tail, len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Turns as (role, text) of a formatted text."""
    turns, role, held = [], None, ""
    for piece in _CONTROL.split(formatted):
        if piece in ("[/INST]", "</s>", "[/TURN]"):
            name = {"[/INST]": "user", "</s>": "assistant"}.get(piece, role)
            turns.append((name, unescaped(held)))
            role, held = None, ""
        elif piece == "[/ROLE]":
            role, held = unescaped(held), ""
        elif piece in CONTROLS:
            held = ""
        else:
            held = piece
    return turns


def paths(nodes: DataFrame) -> DataFrame:
    """conv_id, node, depth and total (score from the root to the node) of every node with a root.

    `nodes` has conv_id, node, parent and score; (conv_id, node) is unique. A parent
    that is null or not there makes a root. Nodes on or below a cycle reach no root
    and are left out. Round i joins each node with its 2**i-th ancestor.
    """
    up = stage(_with_parents(nodes), "replies")
    levels = [up]
    # Twice as far each round; a chain of n nodes takes log2(n) rounds, a cycle no more.
    limit = max(1, nodes.count()).bit_length()
    while len(levels) <= limit and levels[-1].where(F.col("jump").isNotNull()).limit(1).count():
        levels.append(stage(_doubled(levels[-1]), "replies"))
    return levels[-1].where(F.col("jump").isNull()).select("conv_id", "node", "depth", "total")


def _with_parents(nodes: DataFrame) -> DataFrame:
    known = nodes.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"))
    return nodes.join(
        known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_n")), "left"
    ).select(
        "conv_id", "node", F.col("_n").alias("parent"), F.col("_n").alias("jump"),
        F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"),
    )


def _doubled(rows: DataFrame) -> DataFrame:
    above = rows.select(
        F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("jump").alias("_j"),
        F.col("depth").alias("_d"), F.col("total").alias("_t"),
    )
    open_ = rows.where(F.col("jump").isNotNull())  # nodes at their root take part no more
    further = open_.join(
        above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("jump") == F.col("_n"))
    ).select(
        "conv_id", "node", "parent", F.col("_j").alias("jump"),
        (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_t")).alias("total"),
    )
    return further.union(rows.where(F.col("jump").isNull()))


def best_branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The `top` leaves of each conversation: conv_id, leaf, branch (rank from 1), depth, total.

    Branches are ranked by score, then length, then the smaller leaf.
    """
    inner = nodes.where(F.col("parent").isNotNull()).select(
        F.col("conv_id").alias("_c"), F.col("parent").alias("_p")
    ).distinct()
    leaves = paths(nodes).join(
        inner, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_p")), "left_anti"
    )
    rank = F.row_number().over(
        W.partitionBy("conv_id").orderBy(F.col("total").desc(), F.col("depth").desc(), "node")
    )
    return leaves.withColumn("branch", rank).where(F.col("branch") <= top).select(
        "conv_id", F.col("node").alias("leaf"), "branch", "depth", "total"
    )


def branch_nodes(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """conv_id, branch, depth and node along each chosen branch, depth counted from the leaf.

    Self-joins again: what is known up to 2**i steps above a leaf gives twice as far.
    """
    levels = [stage(_with_parents(nodes), "replies")]
    found = leaves.select("conv_id", "branch", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    reach = leaves.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step < reach:
        above = levels[-1].where(F.col("jump").isNotNull()).select(
            F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "jump"
        )
        more = found.join(
            above, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n"))
        ).select("conv_id", "branch", F.col("jump").alias("node"), (F.col("up") + step).alias("up"))
        found = stage(found.union(more), "branches")
        step *= 2
        if step < reach:
            levels.append(stage(_doubled(levels[-1]), "replies"))
    return found


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """One row per chosen branch: conv_id, branch, formatted and mask (assistant text spans).

    `messages` has conv_id, node, parent, role, text and score. A null role or text is
    empty; conversations with a null conv_id are one. Spans are code points of
    `formatted`. A formatted conversation is one value, so it must fit one row.
    """
    nodes = messages.select("conv_id", "node", "parent", "score")
    chosen = branch_nodes(nodes, best_branches(nodes, top))

    def run(batch):
        made = [
            turn_text(r or "", t or "")
            for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
        ]
        return {
            "conv_id": batch.column("conv_id"), "branch": batch.column("branch"), "up": batch.column("up"),
            "learn": [r == "assistant" for r in batch.column("role").to_pylist()],
            "piece": [m[0] for m in made], "first": [m[1] for m in made], "last": [m[2] for m in made],
        }

    content = messages.select(
        F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "role", "text"
    )
    rows = chosen.join(
        content, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n"))
    ).select("conv_id", "branch", "up", "role", "text")
    turns = map_rows(
        rows, run,
        "conv_id long, branch int, up long, learn boolean, piece string, first long, last long",
    )
    whole = turns.groupBy("conv_id", "branch").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "learn", "first", "last"))
        ).alias("turns")
    )
    start = F.lit("<s>")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(3).cast("long").alias("at"), F.array().cast("array<struct<start:long,stop:long>>").alias("out")),
        lambda acc, t: F.struct(
            (acc.at + F.char_length(t.piece)).cast("long").alias("at"),
            F.when(t.learn, F.array_append(
                acc.out, F.struct((acc.at + t["first"]).alias("start"), (acc.at + t["last"]).alias("stop"))
            )).otherwise(acc.out).alias("out"),
        ),
        lambda acc: acc.out,
    )
    return whole.select(
        "conv_id", "branch",
        F.concat(start, F.array_join(F.transform("turns", lambda t: t.piece), "")).alias("formatted"),
        spans.alias("mask"),
    )


def threads(conversations: DataFrame) -> DataFrame:
    """Plain conversations as reply trees: each row answers the row before it by turn.

    Equal turns are ordered by role and text, so repeated rows are turns of their own.
    """
    order: list[Column] = [F.col("turn"), F.col("role"), F.col("text")]
    node = F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("long")
    return (
        conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .withColumn("node", node)
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
        .withColumn("score", F.lit(0.0))
        .drop("turn")
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back."""

    def run(batch):
        out = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, mask in zip(
            batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True
        ):
            turns = read_back(text)
            learned = "".join(unescaped(text[m["start"] : m["stop"]]) for m in mask)
            whole = hashlib.sha256()
            for role, said in turns:
                whole.update(f"{role}\n{said}\n".encode())
            values = (
                len(turns), whole.hexdigest(), len(learned),
                hashlib.sha256(learned.encode()).hexdigest(), len(text),
            )
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return {"conv_id": batch.column("conv_id")} | out

    return map_rows(
        formatted.select("conv_id", "formatted", "mask"), run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )
