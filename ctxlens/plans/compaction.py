"""Compaction of logged requests: background code and stale reads become skeletons.

Shuffles: text units and blocks by request, distinct code by its own hash. Code
travels once, to be made distinct; afterwards blocks carry a hash and only the
skeletons come back to the units that need them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxlens import fixed_values as fv
from ctxlens.functions import variants as V
from ctxlens.functions.once import once
from ctxlens.functions.text import language_of, splice_blocks, strip
from ctxlens.functions.tokens import Counter, heuristic_tokens
from ctxlens.operators import active_files as act
from ctxlens.operators import accounting, cache_plan, messages, policy, ranking, relevance, tool_reads
from ctxlens.operators.skeletons import stored_skeletons
from ctxlens.runtime import stage

UNIT = act.UNIT


@dataclass(frozen=True)
class Options:
    """Switches of a compaction run."""

    passthrough: bool = False
    compress_with_tools: bool = True
    plan_cache: bool = True
    keep_last_reads: int = 1
    keep_docstrings: bool = False
    keep_class_attrs: bool = True
    require_smaller: bool = False
    boost_threshold: float = fv.BOOST_THRESHOLD
    skeleton_header: str | None = None
    skeleton_store: str | None = None  # folder in which skeletons are kept between runs
    note: str = "[stale result of `{file}` replaced by its skeleton: a newer read follows]\n"
    bare_note: str = "[stale result replaced by its skeleton]\n"

    def skeleton_args(self) -> dict:
        args = {
            "keep_docstrings": self.keep_docstrings,
            "keep_class_attrs": self.keep_class_attrs,
            "require_smaller": self.require_smaller,
        }
        if self.skeleton_header is not None:
            args["header"] = self.skeleton_header
        return args


def reduced_blocks(
    units: DataFrame, active: DataFrame, options: Options = Options()
) -> DataFrame:
    """Every block of every unit with activity and, if reduced, its skeleton."""
    marked = act.with_activity(act.blocks(units), active)
    done = stored_skeletons(
        marked.where(~F.col("is_active")).select("language", "code"),
        options.skeleton_store,
        **options.skeleton_args(),
    )
    found = done.where("was_compressed").select(
        "language", "code_hash", "skeleton", F.lit(False).alias("is_active")
    )
    hashed = marked.withColumn("code_hash", F.sha2("code", 256)).withColumn(
        "code_chars", F.length("code")
    ).drop("code")
    return hashed.join(found, ["language", "code_hash", "is_active"], "left").withColumn(
        "was_compressed", F.col("skeleton").isNotNull()
    )


def spliced_units(units: DataFrame, block_rows: DataFrame) -> DataFrame:
    """units with `new_text`; the map per unit holds the blocks of one text only."""
    replaced = (
        block_rows.where("was_compressed")
        .groupBy(*UNIT)
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        "block_idx",
                        F.struct(
                            F.concat("skeleton", F.lit("\n")).alias("code"),
                            F.col("code_chars").alias("old_chars"),
                        ),
                    )
                )
            ).alias("_new_code")
        )
    )
    joined = units.join(replaced, UNIT, "left")
    new_text = once(splice_blocks(F.col("text"), F.col("_new_code")))
    return joined.select(*units.columns, new_text.alias("new_text"))


def compress_plain(
    msgs: DataFrame, detection: DataFrame | None = None, options: Options = Options()
) -> tuple[DataFrame, DataFrame]:
    """(units with new_text, blocks) of a message log, tool roles left alone.

    `detection` replaces the messages scanned for active files, for instance to
    add system prompts; by default all of `msgs` is scanned.
    """
    units = messages.text_units(msgs)
    active = act.active_files(detection if detection is not None else msgs)
    block_rows = reduced_blocks(units.where("editable"), active, options)
    return spliced_units(units, block_rows), block_rows


def reduced_results(
    part_rows: DataFrame, stale: DataFrame, options: Options = Options()
) -> DataFrame:
    """Texts of stale tool results: (request_id, pos, sub_idx, text, new_text).

    `sub_idx` is -1 for a string result, else the index of its text block.
    """
    fields = F.filter(
        F.transform(
            F.coalesce(F.col("result_blocks"), F.array()),
            lambda b, i: F.struct(
                i.cast("int").alias("sub_idx"),
                F.when(b.type == "text", F.coalesce(b.text, F.lit(""))).alias("text"),
            ),
        ),
        lambda e: e.text.isNotNull(),
    )
    entries = F.when(
        F.col("result_text").isNotNull(),
        F.array(F.struct(F.lit(-1).alias("sub_idx"), F.col("result_text").alias("text"))),
    ).otherwise(fields)
    carried = [c for c in ("prefix_end_index",) if c in part_rows.columns]
    texts = (
        part_rows.where(F.col("type") == "tool_result")
        .join(stale, ["request_id", "pos"])
        .select(*UNIT, "pos", *carried, "note_file", F.inline(entries))
        .withColumn("language", F.coalesce(language_of(F.col("note_file")), F.lit("")))
    )
    full = strip(F.col("text")) != ""
    done = stored_skeletons(
        texts.where(full).select("language", F.col("text").alias("code")),
        options.skeleton_store,
        **options.skeleton_args(),
    ).where("was_compressed").select("language", "code_hash", "skeleton")
    before, after = options.note.split("{file}")
    note = F.when(
        F.col("note_file").isNotNull(),
        F.concat(F.lit(before), F.col("note_file"), F.lit(after)),
    ).otherwise(options.bare_note)
    return (
        texts.withColumn("code_hash", F.when(full, F.sha2("text", 256)))
        .join(done, ["language", "code_hash"], "left")
        .select(
            *UNIT,
            "pos",
            *carried,
            "sub_idx",
            "note_file",
            "text",
            F.coalesce(F.concat(note, "skeleton"), "text").alias("new_text"),
            F.col("skeleton").isNotNull().alias("was_compressed"),
        )
    )


@dataclass(frozen=True)
class Compaction:
    """Tables of one run; each is lazy, so unused ones cost nothing.

    A log may repeat a request id (a retry keeps it) or lack it. Inside a run
    `request_id` is therefore a number of the log row, and `given_id` of `requests`
    the id as logged; all other tables that come out have the logged one.
    """

    requests: DataFrame
    keyed_units: DataFrame
    keyed_blocks: DataFrame
    keyed_results: DataFrame

    def _named(self, rows: DataFrame) -> DataFrame:
        """`rows` with the logged request ids."""
        others = [c for c in rows.columns if c != "request_id"]
        return rows.join(self.requests.select("request_id", "given_id"), "request_id").select(
            F.col("given_id").alias("request_id"), *others
        )

    @property
    def units(self) -> DataFrame:
        return self._named(self.keyed_units)

    @property
    def blocks(self) -> DataFrame:
        return self._named(self.keyed_blocks)

    @property
    def results(self) -> DataFrame:
        return self._named(self.keyed_results)

    def block_counts(self) -> DataFrame:
        """total_blocks and skeletonized_blocks per request, result texts included."""
        both = self.keyed_blocks.select("request_id", "was_compressed").unionByName(
            self.keyed_results.select("request_id", "was_compressed")
        )
        return self._named(act.block_counts(both))

    def request_metrics(self, tokens: Counter = heuristic_tokens) -> DataFrame:
        """Tokens before and after per request, plus tokens saved in tool results.

        Requests to endpoints that are only passed through are not metered.
        """
        overhead = F.col("n_counted") * fv.TOKENS_PER_MESSAGE + fv.TOKENS_PER_REPLY
        after_overhead = (
            F.col("n_sent") * fv.TOKENS_PER_MESSAGE + fv.TOKENS_PER_REPLY
        )
        counted = self.keyed_units.groupBy("request_id").agg(
            F.sum(F.when(F.col("counted_before"), tokens(F.col("text")))).alias("_before"),
            F.sum(tokens(F.col("new_text"))).alias("_after"),
        )
        in_results = self.keyed_results.groupBy("request_id").agg(
            F.sum(tokens(F.col("text")) - tokens(F.col("new_text"))).alias("_results")
        )
        kept = [c for c in ("ts",) if c in self.requests.columns]
        zero = F.lit(0).cast("bigint")
        return (
            self.requests.where(F.col("api") != "other")
            .select("request_id", "given_id", *kept, "model", "policy", "n_counted", "n_sent")
            .join(counted, "request_id", "left")
            .join(in_results, "request_id", "left")
            .select(
                F.col("given_id").alias("request_id"),
                *kept,
                "model",
                "policy",
                (overhead + F.coalesce("_before", zero)).cast("bigint").alias("original_tokens"),
                (after_overhead + F.coalesce("_after", zero))
                .cast("bigint")
                .alias("compressed_tokens"),
                F.coalesce("_results", zero).alias("tool_result_tokens_saved"),
            )
        )

    def rewritten_bodies(self) -> DataFrame:
        """(request_id, body VARIANT) as it would be sent on.

        Only changed texts are gathered, per request: no more than one body holds.
        """
        changed = F.col("new_text") != F.col("text")
        in_units = self.keyed_units.where(changed).select(
            "request_id", "msg_idx", "part_idx", F.lit(-1).alias("sub_idx"), "new_text"
        )
        in_results = self.keyed_results.where(changed).select(
            "request_id", "msg_idx", "part_idx", "sub_idx", "new_text"
        )
        edits = (
            in_units.unionByName(in_results)
            .groupBy("request_id")
            .agg(
                F.collect_list(F.struct("msg_idx", "part_idx", "sub_idx", "new_text")).alias(
                    "edits"
                )
            )
        )
        full = cache_plan.marked_bodies(self.requests, F.col("is_planned"))
        return full.join(edits, "request_id", "left").select(
            F.col("given_id").alias("request_id"),
            F.when(F.col("edits").isNull(), F.col("body")).otherwise(_edited_body()).alias("body"),
        )


def _own(edits: Column, name: str, index: Column | int) -> Column:
    """Edits that concern one message, part or block."""
    wanted = F.lit(index) if isinstance(index, int) else index.cast("int")
    return F.filter(edits, lambda e: e[name] == wanted)


def _new_text(edits: Column) -> Column:
    return F.get(edits, F.lit(0)).new_text


def _with_text(v: Column, key: str, edits: Column) -> Column:
    """Object with its text put in place of the old one, if there is an edit for it."""
    return V.let(
        _new_text(edits),
        lambda text: F.when(text.isNull(), v).otherwise(
            V.with_key(v, key, text.cast("variant"))
        ),
    )


def _edited_part(p: Column, edits: Column) -> Column:
    """Part with its own text, its string result or blocks of its result replaced."""
    key = F.try_variant_get(p, "$.type", "string")
    blocks = F.transform(
        V.as_list(V.field(p, "content")),
        lambda b, k: _with_text(b, "text", _own(edits, "sub_idx", k)),
    )
    whole = _own(edits, "sub_idx", -1)
    return (
        F.when(F.size(edits) == 0, p)
        .when(key == "text", _with_text(p, "text", whole))
        .when(F.size(whole) > 0, _with_text(p, "content", whole))
        .otherwise(V.with_key(p, "content", F.to_variant_object(blocks)))
    )


def _edited_message(m: Column, i: Column) -> Column:
    """Message with its changed texts put back at their positions."""

    def edit(own: Column) -> Column:
        listed = F.transform(
            V.as_list(V.field(m, "content")),
            lambda p, j: V.let(_own(own, "part_idx", j), lambda e: _edited_part(p, e)),
        )
        return (
            F.when(F.size(own) == 0, m)
            .when(F.get(own, F.lit(0)).part_idx == -1, _with_text(m, "content", own))
            .otherwise(V.with_key(m, "content", F.to_variant_object(listed)))
        )

    return V.let(_own(F.col("edits"), "msg_idx", i), edit)


def _edited_body() -> Column:
    """Body with the edits in its message list, or in its input list or text."""
    body = F.col("body")

    def listed(key: str) -> Column:
        return F.to_variant_object(
            F.transform(V.as_list(V.field(body, key)), _edited_message)
        )

    return (
        F.when(F.col("api") != "responses", V.with_key(body, "messages", listed("messages")))
        .when(F.col("input_kind") == "string", _with_text(body, "input", F.col("edits")))
        .otherwise(V.with_key(body, "input", listed("input")))
    )


def relevant_files(msgs: DataFrame, corpus: DataFrame, threshold: float) -> DataFrame:
    """boosted(request_id, file_key): files of the corpus that suit a request's last question."""
    questions = messages.last_user_text(msgs).withColumnRenamed("request_id", "query_id")
    scores = relevance.files_above(ranking.summaries(corpus), questions, threshold)
    return ranking.boosted_files(scores, threshold).withColumnRenamed("query_id", "request_id")


def compact(
    parsed: DataFrame, options: Options = Options(), corpus: DataFrame | None = None
) -> Compaction:
    """Plan, compact and guard all requests of a parsed log.

    Cache plans come first, on the bodies as logged. Messages up to the end of a
    planned prefix keep their text, so that it stays the same on the next turn.
    Policy and prefix end are computed on the request row and carried along when
    messages are taken apart, so they cost no join.

    With a corpus, code_files(repo, path, content), files that suit a request's last
    question are active too.

    The numbered and typed requests are written once to the shared checkpoint folder:
    JSON is taken apart in one pass, and each operator then reads only the columns it
    needs. Only rewritten bodies read the body column.
    """
    numbered = parsed.withColumn("given_id", F.col("request_id")).withColumn(
        "request_id", F.monotonically_increasing_id()
    )
    reqs = policy.request_policy(
        messages.requests(numbered), options.passthrough, options.compress_with_tools
    )
    cached = (F.col("api") == "messages") & F.lit(
        options.plan_cache and not options.passthrough
    )
    planned = cache_plan.plan_requests(reqs).withColumn(
        "prefix_end_index", F.when(cached, F.col("prefix_end_index")).otherwise(-1)
    )
    skipped = messages.is_skipped_item
    items = F.filter("items", lambda m: m.is_object)
    responses = F.col("api") == "responses"
    n_before = F.size(F.filter(items, lambda m: ~skipped(m)))
    n_after = F.size(
        F.filter(
            items,
            lambda m: (m.content_kind != "missing")
            | ((F.col("policy") != "none") & ~skipped(m)),
        )
    )
    no_markers = F.slice("markers", 1, 0)
    requests = stage(
        planned.withColumn("n_counted", F.when(responses, n_before).otherwise(F.size(items)))
        .withColumn("n_sent", F.when(responses, n_after).otherwise(F.size(items)))
        .withColumn("is_planned", cached)
        .withColumn("markers", F.when(cached, F.col("markers")).otherwise(no_markers))
        .drop("headers"),
        "requests",
    )

    carried = ["policy", "prefix_end_index"]
    msgs = messages.messages(requests, carry=carried, keep_skipped=True)
    aware = F.col("policy") == "tool_aware"
    guard = F.col("msg_idx") <= F.col("prefix_end_index")

    units = messages.text_units(msgs, aware, carry=[*carried, "is_skipped"])
    open_units = units.where(
        F.col("editable") & (F.col("policy") != "none") & ~F.col("is_skipped")
    )
    spoken = msgs.where(~F.col("is_skipped"))
    boosted = None
    if corpus is not None:
        boosted = relevant_files(
            spoken.where(F.col("policy") != "none"), corpus, options.boost_threshold
        )
    active = act.active_files(spoken, boosted)
    block_rows = reduced_blocks(open_units, active, options)
    spliced = (
        spliced_units(units, block_rows)
        .withColumn("new_text", F.when(guard, F.col("text")).otherwise(F.col("new_text")))
        .withColumn("counted_before", ~F.col("is_skipped"))
    )

    part_rows = messages.parts(msgs.where(aware), carry=["prefix_end_index"])
    stale = tool_reads.stale_results(
        messages.tool_events(part_rows), options.keep_last_reads
    )
    results = reduced_results(part_rows, stale, options).withColumn(
        "new_text", F.when(guard, F.col("text")).otherwise(F.col("new_text"))
    )
    return Compaction(requests, spliced, block_rows, results)
