"""Trajectories and conversations: flattening, cleaning, call extraction, chains, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.answers import strip
from engramlake.functions.scale import islands, lagged, running_sum

# Chat markers, tool names, call syntaxes, limits.
START, END = "<|im_start|>", "<|im_end|>"
SPECIAL_TOKENS = ["<|im_end|>", "<|endoftext|>", "<|im_start|>"]
THINK = r"(?s)<think>.*?</think>\s*"
KNOWN_TOOLS = [
    "Write", "Edit", "Read", "memory_store", "memory_search", "memory_get", "memory_forget", "memory_list",
    "submit_answer",
]
WRITE_KINDS = ["Write", "Edit", "write_memory", "edit_memory", "memory_store"]
SEARCH_KINDS = ["memory_search", "memory_list", "memory_get", "Read", "read_memory"]
TAGGED = r"(?s)<(?:tool_call|function_call)>(.*?)</(?:tool_call|function_call)>"
FENCED = r"(?s)```(?:json)?\s*\n(\{.*?\})\s*\n```"
BARE = r'\{[^{}]*"name"\s*:\s*"[^"]+?"[^{}]*"arguments"\s*:\s*\{[^{}]*\}[^{}]*\}'
SUBMITTED = r"ANSWER_SUBMITTED:\s*(.+)"
SEPARATOR = "\n\n---\n\n"
CONTEXT_LIMIT, CONTEXT_TAIL = 24, 22
REPEAT_LIMIT, DEAD_LIMIT = 5, 2

TRAJECTORY_SCHEMA = (
    "conv_id string, event_idx bigint, type string, content string, turns array<struct<role: string, content: string, "
    "tool_calls: array<struct<name: string, arguments: string>>, tool_results: array<string>>>"
)


def trajectory_to_messages(events: DataFrame, conv: str = "conv_id", chunk_rows: int = 1_000_000) -> DataFrame:
    """Flatten logged events to chat rows ordered by (event_idx, turn_idx, part, item).

    Calls are numbered through the whole conversation; each tool row points at its call. Results beyond
    the calls keep no id; assistant rows without content and calls are dropped. The call numbers come from
    a running sum of call counts, one number per turn.
    """
    system = F.col("type") == "system"
    has_text = F.coalesce(F.col("content") != "", F.lit(False))
    none = F.lit(None).cast("string")
    head = events.where(system | has_text).select(
        conv, "event_idx", F.lit(-1).alias("turn_idx"), F.lit(0).alias("part"), F.lit(0).alias("item"),
        F.when(system, "system").otherwise("user").alias("role"), F.coalesce("content", F.lit("")).alias("content"),
        none.alias("tool_call_id"), none.alias("name"), F.lit(0).alias("n_calls"),
    )
    turns = events.where(~system).select(conv, "event_idx", F.posexplode("turns").alias("turn_idx", "t")).where(
        F.col("t.role") == "assistant"
    )
    calls = F.coalesce(F.col("t.tool_calls"), F.array().cast("array<struct<name: string, arguments: string>>"))
    turns = turns.select(
        conv, "event_idx", "turn_idx",
        F.col("t.content").alias("content"), calls.alias("calls"),
        F.coalesce(F.col("t.tool_results"), F.array().cast("array<string>")).alias("results"),
    )
    # calls before a turn: those of earlier events, and those of earlier turns of its own
    events_calls = turns.groupBy(conv, "event_idx").agg(F.sum(F.size("calls")).alias("__n"))
    before = running_sum(events_calls, [conv], "event_idx", {"__before": F.col("__n")}, inclusive=False, chunk_rows=chunk_rows)
    turns = running_sum(turns, [conv, "event_idx"], "turn_idx", {"__in": F.size("calls")}, inclusive=False, chunk_rows=chunk_rows)
    turns = turns.join(before.select(conv, "event_idx", "__before"), [conv, "event_idx"])
    turns = turns.withColumn("base", (F.col("__before") + F.col("__in")).cast("bigint")).drop("__before", "__in")
    n = F.size("calls")
    ids = F.transform("calls", lambda c, i: F.concat(F.lit("call_"), (F.col("base") + i).cast("string")))
    said = F.coalesce(F.col("content") != "", F.lit(False))
    assistant = turns.where(said | (n > 0)).select(
        conv, "event_idx", "turn_idx", F.lit(1).alias("part"), F.lit(0).alias("item"), F.lit("assistant").alias("role"),
        F.coalesce("content", F.lit("")).alias("content"), F.array_join(ids, ",").alias("tool_call_id"),
        F.array_join(F.transform("calls", lambda c: c["name"]), ",").alias("name"), n.alias("n_calls"),
    )
    tool = turns.select(conv, "event_idx", "turn_idx", "base", "calls", F.posexplode("results").alias("item", "r"))
    text = strip("r")
    linked = F.col("item") < F.size("calls")
    tool = tool.select(
        conv, "event_idx", "turn_idx", F.lit(2).alias("part"), "item", F.lit("tool").alias("role"),
        F.when(F.startswith(text, F.lit("[tool]")), strip(F.substring(text, 7, 2147483647))).otherwise(text).alias("content"),
        F.when(linked, F.concat(F.lit("call_"), (F.col("base") + F.col("item")).cast("string"))).alias("tool_call_id"),
        F.when(linked, F.try_element_at("calls", F.col("item") + 1)["name"]).alias("name"), F.lit(0).alias("n_calls"),
    )
    return head.unionByName(assistant).unionByName(tool)


def strip_markup(text: Column) -> Column:
    """Drop thinking blocks and chat tokens."""
    out = F.regexp_replace(text, THINK, "")
    for token in SPECIAL_TOKENS:
        out = F.replace(out, F.lit(token), F.lit(""))
    return strip(out)


def clean_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.withColumn(text, strip_markup(F.col(text)))


def _parsed(raws: Column) -> Column:
    """Calls among JSON texts, closing up to two missing braces; unknown tools drop out.

    Two steps, so that a text is parsed once however many of its fields are read.
    """
    docs = F.transform(raws, lambda r: F.coalesce(
        F.try_parse_json(r), F.try_parse_json(F.concat(r, F.lit("}"))), F.try_parse_json(F.concat(r, F.lit("}}")))
    ))
    calls = F.transform(docs, lambda v: F.struct(
        F.try_variant_get(v, "$.name", "string").alias("tool"),
        F.coalesce(F.to_json(F.try_variant_get(v, "$.arguments", "variant")), F.lit("{}")).alias("arguments"),
    ))
    return F.filter(calls, lambda c: F.coalesce(c["tool"].isin(KNOWN_TOOLS), F.lit(False)))


def extract_tool_calls(messages: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(tool, arguments) rows: tagged calls of a message, else fenced ones, else bare JSON.

    Each tier is a column of its own, so it is parsed once and only where the tiers before came out empty.
    """

    def tier(pattern: str, group: int) -> Column:
        return _parsed(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))

    d = messages.withColumn("__c", tier(TAGGED, 1))
    d = d.withColumn("__c", F.when(F.size("__c") > 0, F.col("__c")).otherwise(tier(FENCED, 1)))
    d = d.withColumn("__c", F.when(F.size("__c") > 0, F.col("__c")).otherwise(tier(BARE, 0)))
    # the outer form keeps the optimizer from evaluating the array again for a size filter
    d = d.select(*keys, F.posexplode_outer("__c").alias("call_idx", "c")).where(F.col("call_idx").isNotNull())
    return d.select(*keys, "call_idx", "c.tool", "c.arguments")


def merge_same_role(messages: DataFrame, conv: str, turn: str, separator: str = SEPARATOR, chunk_rows: int = 1_000_000) -> DataFrame:
    """Join neighbouring messages of the same role."""
    d = islands(messages.select(conv, turn, "role", "text"), [conv], turn, "role", "__island", chunk_rows=chunk_rows)
    parts = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("text").alias("x"))))
    return d.groupBy(conv, F.col("__island").alias("message_idx"), "role").agg(
        F.count(F.lit(1)).alias("n_merged"), F.array_join(F.transform(parts, lambda p: p["x"]), separator).alias("text")
    )


def short_action(tool: Column) -> Column:
    return F.lower(F.replace(F.replace(tool, F.lit("memory_"), F.lit("")), F.lit("submit_"), F.lit("")))


def action_chain(calls: DataFrame, keys: Sequence[str], seq: str, chunk_rows: int = 1_000_000) -> DataFrame:
    """Per event: short tool names in order without neighbouring repeats, plus counts by kind."""
    keys = list(keys)
    d = calls.withColumn("__a", short_action(F.col("tool"))).where(F.col("__a") != "")
    d = lagged(d, keys, seq, {"__prev": "__a"}, chunk_rows=chunk_rows)
    keep = ~F.col("__a").eqNullSafe(F.col("__prev"))
    steps = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(seq).alias("s"), F.col("__a").alias("a")))))
    return d.groupBy(*keys).agg(
        F.array_join(F.transform(steps, lambda x: x["a"]), " → ").alias("chain"),
        F.count_if(F.col("tool").isin(WRITE_KINDS)).alias("n_writes"),
        F.count_if(F.col("tool").isin(SEARCH_KINDS)).alias("n_searches"),
    )


def search_queries(calls: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Non-empty queries of memory_search calls. ``arguments`` is a map."""
    q = F.try_element_at("arguments", F.lit("query"))
    return calls.where((F.col("tool") == "memory_search") & F.coalesce(q != "", F.lit(False))).select(
        *keys, seq, q.alias("query")
    )


def stored_keys(calls: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Name before the first pipe of each written entry, else its first 40 characters."""
    c = F.coalesce(F.try_element_at("arguments", F.lit("content")), F.lit(""))
    key = F.when(F.contains(c, F.lit("|")), strip(F.substring_index(c, "|", 1))).otherwise(F.substring(c, 1, 40))
    return calls.where(F.col("tool").isin("Write", "memory_store") & (c != "")).select(*keys, seq, key.alias("stored_key"))


def trajectory_summary(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run: entities seen, writes, searches, API calls, accuracy, corrections stored."""
    t = F.col("type")
    ingest, corr, question = t == "ingest", t == "correction", t == "question"
    total = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    d = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_events"),
        total("n_entities", ingest).alias("entities_seen"),
        total("writes", ingest | corr).alias("total_writes"),
        total("searches", ingest | question).alias("total_searches"),
        total("api_calls", ingest | corr | question).alias("total_api_calls"),
        F.count_if(question).alias("n_questions"),
        F.count_if(question & F.col("correct")).alias("n_correct"),
        F.count_if(corr).alias("n_corrections"),
        F.count_if(corr & F.col("did_store")).alias("n_corrections_stored"),
    )
    return d.withColumn("accuracy", F.coalesce(F.try_divide(F.col("n_correct"), F.col("n_questions")), F.lit(0.0)))


def batch_store_rates(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ingest event: writes per entity and the budget left after it."""
    return events.where(F.col("type") == "ingest").select(
        *keys, "event_idx", "writes", "n_entities",
        F.coalesce(F.try_divide(F.col("writes"), F.col("n_entities")), F.lit(0.0)).alias("store_rate"), "budget_remaining",
    )


def last_submitted_answer(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Answer of the last message carrying the submission marker."""
    answer = strip(F.regexp_extract("text", SUBMITTED, 1))
    return messages.where(F.col("text").rlike(SUBMITTED)).groupBy(conv).agg(
        F.max_by(answer, turn).alias("answer"), F.max(turn).alias("answer_turn")
    )


def trim_context(messages: DataFrame, conv: str, turn: str, limit: int = CONTEXT_LIMIT, tail: int = CONTEXT_TAIL,
                 chunk_rows: int = 1_000_000) -> DataFrame:
    """More than 24 messages: keep the first and the last 22."""
    d = running_sum(messages, [conv], turn, {"__rn": F.lit(1)}, chunk_rows=chunk_rows)
    n = messages.groupBy(conv).agg(F.count(F.lit(1)).alias("__n"))
    return d.join(n, conv).where(
        (F.col("__n") <= limit) | (F.col("__rn") == 1) | (F.col("__rn") > F.col("__n") - tail)
    ).select(*messages.columns)


def stalled_runs(turns: DataFrame, keys: Sequence[str], seq: str, event: str = "event", only_rejected: str = "only_rejected",
                 chunk_rows: int = 1_000_000) -> DataFrame:
    """Runs stuck on one event for >= 5 repeats, or with >= 2 turns in a row of rejected writes only."""
    keys = list(keys)
    cols = [*keys, seq, event, only_rejected]
    a = islands(turns.select(*cols), keys, seq, event, "__i", chunk_rows=chunk_rows).groupBy(*keys, "__i").agg(
        (F.count(F.lit(1)) - 1).alias("__repeats")
    ).groupBy(*keys).agg(F.max("__repeats").alias("max_repeats"))
    b = islands(turns.select(*cols), keys, seq, only_rejected, "__i", chunk_rows=chunk_rows).groupBy(*keys, "__i", only_rejected).agg(
        F.count(F.lit(1)).alias("__len")
    ).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(only_rejected), F.col("__len"))), F.lit(0)).alias("max_dead_turns"))
    return a.join(b, keys).select(
        "*", (F.col("max_repeats") >= REPEAT_LIMIT).alias("stuck"), (F.col("max_dead_turns") >= DEAD_LIMIT).alias("dead_budget")
    )


def assistant_spans(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", chunk_rows: int = 1_000_000) -> DataFrame:
    """Character spans [start, end) of assistant text, end marker included, in the rendered chat.

    A message renders as start marker, role, newline, text, end marker, newline.
    """
    head = F.lit(len(START)) + F.length("role") + 1
    size = head + F.length("text") + len(END) + 1
    d = running_sum(messages, [conv], turn, {"__at": size}, inclusive=False, chunk_rows=chunk_rows)
    start = F.col("__at") + head
    return d.where(F.col("role") == "assistant").select(
        conv, turn, start.cast("bigint").alias("start"), (start + F.length("text") + len(END)).cast("bigint").alias("end")
    )


def span_stats(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Assistant turns and the trainable share of the rendered characters."""
    size = F.lit(len(START)) + F.length("role") + 1 + F.length("text") + len(END) + 1
    mine = F.when(F.col("role") == "assistant", F.length("text") + len(END)).otherwise(0)
    return messages.groupBy(conv).agg(
        F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.sum(size).alias("n_chars"),
        F.sum(mine).alias("n_trainable"), (F.sum(mine) / F.sum(size)).alias("trainable_share"),
    )


def count_turns_in_text(text: Column) -> Column:
    """Assistant turns of an already rendered chat."""
    return F.regexp_count(text, F.lit(r"<\|im_start\|>assistant"))
