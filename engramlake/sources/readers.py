"""Readers for result files, trajectories, traces, logs and memory snapshots; writers for chat data."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions.answers import strip
from engramlake.functions.text import normal_topic
from engramlake.operators.convo import THINK, TRAJECTORY_SCHEMA
from engramlake.operators.scoring import infer_tier

RESULT_SCHEMA = """
task_name string, score double, success boolean, time_taken double, error string,
extra struct<model: string, template: string, seed: bigint, n_entities: bigint, n_questions: bigint, write_budget: bigint,
  writes_used: bigint, stored_entities: bigint,
  per_axis: struct<breadth: double, maintenance: double, reasoning: double, efficiency: double, composite: double>,
  by_competency: map<string, double>>
"""
TRAJECTORY_MARK = "_trajectory"
# Formats of traces, memory files and training logs.
MEMORY_DELIMITER = "\n§\n"
TIMESTAMP_HEADER = r"^\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\]\n"
WRITE_ACTIONS = ["add", "replace", "remove"]
METRIC_LINE = (
    r"\{'loss': '?([\d.e-]+)'?.*?'grad_norm': '?([\d.e-]+)'?.*?'learning_rate': '?([\d.e-]+)'?.*?'epoch': '?([\d.]+)'?"
)
EPISODE_LINE = (
    r"\[(\d+)/(\d+)\]\s+G(\d+)S(\d+)\s+(\w+)\(s=(\d+)\):\s+r=([\d.]+).*?correct=(\d+)/(\d+)\s+writes=(\d+)\s+msgs=(\d+)"
)
STEP_LINE = r"Step\s+(\d+):\s+loss=(-?[\d.]+)\s+mean_r=([\d.]+)"


def plain_name(name: Column) -> Column:
    """A file name as on disk: the metadata column percent-encodes it."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def file_key(name: Column) -> Column:
    """File name without folder, the .json ending and the trajectory mark."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), rf"({TRAJECTORY_MARK})?\.jsonl?$", "")


def read_eval_results(spark: SparkSession, path: str, *, multi_line: bool = True, glob: str = "*.json") -> DataFrame:
    """Flat rows of successful results; trajectory files, old formats and broken JSON are skipped.

    ``multi_line`` reads one (possibly pretty-printed) document per file; turn it off for JSON lines,
    which split.
    """
    raw = (
        spark.read.schema(RESULT_SCHEMA).option("multiLine", multi_line).option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(path)
        .select("*", plain_name(F.col("_metadata.file_name")).alias("file_name"))
    )
    d = raw.where(
        ~F.contains("file_name", F.lit("trajectory")) & F.col("task_name").isNotNull() & (F.coalesce("error", F.lit("")) == "")
    )
    e = F.col("extra")
    return d.select(
        file_key(F.col("file_name")).alias("file_key"), "task_name", e["model"].alias("model"), e["template"].alias("template"),
        e["seed"].alias("seed"), "score", F.coalesce(e["per_axis"]["composite"], F.col("score")).alias("composite"),
        infer_tier(e["n_entities"]).alias("tier"), e["n_entities"].alias("n_entities"), e["n_questions"].alias("n_questions"),
        e["write_budget"].alias("write_budget"), e["writes_used"].alias("writes_used"), e["stored_entities"].alias("stored_entities"),
        e["by_competency"].alias("by_competency"), "time_taken",
    )


def read_trajectories(spark: SparkSession, path: str, schema: str = TRAJECTORY_SCHEMA, *, multi_line: bool = True,
                      glob: str = "*.json") -> DataFrame:
    """Trajectory events with their nested turns; a file holds a JSON array (or lines) of events."""
    return (
        spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(path)
        .select("*", file_key(plain_name(F.col("_metadata.file_name"))).alias("file_key"))
    )


def link_result_trajectory(results: DataFrame, trajectory_files: DataFrame) -> DataFrame:
    """Add ``has_trajectory``: a companion file with the same key exists."""
    keys = trajectory_files.select("file_key").distinct().withColumn("__t", F.lit(True))
    return results.join(keys, "file_key", "left").withColumn("has_trajectory", F.col("__t").isNotNull()).drop("__t")


def read_agent_trace(spark: SparkSession, path: str, keys: Sequence[str] = (), *, sep: str | None = None) -> DataFrame:
    """One row per readable trace line: type, data (JSON text), file and line order.

    Blank and broken lines are skipped; ``data`` may be an object or JSON text holding one. ``keys`` are
    partition columns of the folder; with ``sep`` they stand in front of each line instead, each followed by it
    (an empty one is null), so that a file holds many traces. Line order is the split's offset, then the order
    within the split.
    """
    own, text = [F.col(k) for k in keys], F.col("value")
    if sep is not None:
        parts = F.split("value", re.escape(sep), len(keys) + 1)
        own = [F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(k) for i, k in enumerate(keys)]
        text = F.get(parts, F.lit(len(keys)))
    lines = spark.read.text(path).select(
        *own, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), text.alias("value"),
    )
    v = F.try_parse_json("value")
    inner = F.try_variant_get(v, "$.data", "string")
    d = lines.where(strip("value") != "").withColumn("__v", v).where(F.col("__v").isNotNull())
    return d.select(
        *keys, "file_path", "block", "line", F.try_variant_get(F.col("__v"), "$.type", "string").alias("type"),
        F.coalesce(F.try_parse_json(inner), F.try_parse_json(F.lit("{}"))).alias("data"),
    )


def rollup_trace(trace: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per turn: tool calls, memory writes, API calls, final text, error, stop reason.

    Without a usage record a turn with calls or text counts as one API call. A turn that ended for another
    reason than completion has that as its error unless an error came first; running out of turns is a stop
    reason only.
    """
    get = lambda p: F.try_variant_get("data", p, "string")
    kind, at = F.col("type"), F.struct("block", "line")
    request = kind == "tool.request"
    writes = request & (get("$.tool") == "memory") & get("$.args.action").isin(WRITE_ACTIONS)
    text = strip(F.regexp_replace(F.coalesce(get("$.text"), F.lit("")), THINK, ""))
    reason = get("$.reason")
    abnormal = (kind == "turn.end") & reason.isNotNull() & (reason != "completed")
    d = trace.groupBy(*keys).agg(
        F.count_if(request).alias("n_tool_calls"),
        F.count_if(F.coalesce(writes, F.lit(False))).alias("n_writes"),
        F.count_if(kind == "tool.result").alias("n_results"),
        F.count_if(kind == "usage").alias("__usage"),
        F.coalesce(F.max_by(F.when(kind == "message.done", text), F.when(kind == "message.done", at)), F.lit("")).alias("final_text"),
        F.max_by(F.when(kind == "error", F.coalesce(get("$.message"), F.lit("agent error"))), F.when(kind == "error", at)).alias("__error"),
        F.max_by(F.when(abnormal, reason), F.when(abnormal, at)).alias("stop_reason"),
        F.min_by(F.when(abnormal & (reason != "max_turns"), reason), F.when(abnormal & (reason != "max_turns"), at)).alias("__end"),
    )
    busy = (F.col("n_tool_calls") > 0) | (F.col("final_text") != "")
    return d.select(
        *keys, "n_tool_calls", "n_writes", "n_results",
        F.when((F.col("__usage") == 0) & busy, 1).otherwise(F.col("__usage")).cast("bigint").alias("api_calls"), "final_text",
        F.coalesce("__error", F.concat(F.lit("turn ended: "), F.col("__end"))).alias("error"), "stop_reason",
    )


def trace_results(trace: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tool results in full, or their preview where an older log lacks the full text."""
    get = lambda p: F.try_variant_get("data", p, "string")
    return trace.where(F.col("type") == "tool.result").select(
        *keys, "block", "line", F.coalesce(get("$.result"), get("$.result_summary"), F.lit("")).alias("result")
    )


def parse_training_logs(lines: DataFrame, text: str = "value") -> DataFrame:
    """One typed row per recognised log line: trainer metrics, episodes and step summaries.

    Numbers sit in the slots of their kind; split the frame with ``kind`` for three tables.
    """
    c = F.col(text)
    num = lambda p, g: F.regexp_extract(c, p, g).try_cast("double")
    whole = lambda p, g: F.regexp_extract(c, p, g).try_cast("bigint")
    kind = F.when(c.rlike(METRIC_LINE), "metric").when(c.rlike(EPISODE_LINE), "episode").when(c.rlike(STEP_LINE), "step")
    d = lines.withColumn("kind", kind).where(F.col("kind").isNotNull())
    k = F.col("kind")
    is_m, is_e, is_s = k == "metric", k == "episode", k == "step"
    return d.select(
        "kind",
        F.when(is_m, num(METRIC_LINE, 1)).when(is_s, num(STEP_LINE, 2)).alias("loss"),
        F.when(is_m, num(METRIC_LINE, 2)).alias("grad_norm"), F.when(is_m, num(METRIC_LINE, 3)).alias("learning_rate"),
        F.when(is_m, num(METRIC_LINE, 4)).alias("epoch"),
        F.when(is_e, whole(EPISODE_LINE, 1)).when(is_s, whole(STEP_LINE, 1)).alias("step"),
        F.when(is_e, whole(EPISODE_LINE, 2)).alias("total_steps"), F.when(is_e, whole(EPISODE_LINE, 3)).alias("group_idx"),
        F.when(is_e, whole(EPISODE_LINE, 4)).alias("sample_idx"), F.when(is_e, F.regexp_extract(c, EPISODE_LINE, 5)).alias("template"),
        F.when(is_e, whole(EPISODE_LINE, 6)).alias("seed"), F.when(is_e, num(EPISODE_LINE, 7)).alias("reward"),
        F.when(is_e, whole(EPISODE_LINE, 8)).alias("correct"), F.when(is_e, whole(EPISODE_LINE, 9)).alias("total_questions"),
        F.when(is_e, whole(EPISODE_LINE, 10)).alias("writes"), F.when(is_e, whole(EPISODE_LINE, 11)).alias("messages"),
        F.when(is_s, num(STEP_LINE, 3)).alias("mean_reward"),
    )


def split_entries(text: Column) -> Column:
    """Entries of a delimited memory file without their timestamp headers."""
    parts = F.split(text, MEMORY_DELIMITER)
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), TIMESTAMP_HEADER, ""), r"^\s+|\s+$", ""))
    return F.filter(clean, lambda p: p != "")


def split_paragraphs(text: Column) -> Column:
    """Paragraphs separated by blank lines."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def snapshot_entries(files: DataFrame, keys: Sequence[str], text: str = "value", *, delimited: bool = True) -> DataFrame:
    """Ordered entries of each memory file."""
    parts = split_entries(F.col(text)) if delimited else split_paragraphs(F.col(text))
    return files.select(*keys, F.posexplode(parts).alias("position", "content"))


def read_memory_snapshot(spark: SparkSession, path: str, *, delimited: bool = True, glob: str = "*.md") -> DataFrame:
    """Memory files to (topic, position, content); the topic is the file's stem. Files are small by their budget."""
    files = (
        spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
        .select("value", F.regexp_extract(plain_name(F.col("_metadata.file_name")), r"^(.*?)(\.[^.]*)?$", 1).alias("__stem"), F.col("_metadata.file_path").alias("file_path"))
    )
    return snapshot_entries(files.withColumn("topic", normal_topic(F.col("__stem"))), ["file_path", "topic"], delimited=delimited)


def pending_evaluations(spark: SparkSession, models: DataFrame, templates: Sequence[str], seeds: int, existing: DataFrame) -> DataFrame:
    """(model, template, seed) combinations without a successful result.

    ``existing``: model, template, seed of successful runs. Templates and seeds are short lists expanded
    per model.
    """
    wanted = models.select(
        "model", F.explode(F.array(*[F.lit(x) for x in templates])).alias("template")
    ).select("model", "template", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(seeds - 1).cast("bigint"))).alias("seed"))
    return wanted.join(existing.select("model", "template", F.col("seed").cast("bigint").alias("seed")), ["model", "template", "seed"], "left_anti")


def chat_records(messages: DataFrame, keys: Sequence[str], turn: str = "turn") -> DataFrame:
    """One ``messages`` array per conversation in turn order: the shape fine-tuning files use."""
    m = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("role").alias("role"), F.col("text").alias("content"))))
    return messages.groupBy(*keys).agg(
        F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    )


def write_chat_dataset(records: DataFrame, path: str, partition_by: Sequence[str] = ("template",)) -> None:
    """JSON lines with a ``messages`` array, one folder per template (and strategy)."""
    records.select(*partition_by, "messages").write.mode("errorifexists").partitionBy(*partition_by).json(path)


def read_chat_dataset(spark: SparkSession, path: str) -> DataFrame:
    schema = "template string, messages array<struct<role: string, content: string>>"
    return spark.read.schema(schema).json(path)


def dataset_stats(records: DataFrame, by: Sequence[str] = ("template",)) -> DataFrame:
    """Trajectories and messages per template."""
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trajectories"), F.sum(F.size("messages")).alias("total_messages"),
        F.avg(F.size("messages")).alias("avg_messages"),
    )


def write_leaderboard_csv(board: DataFrame, path: str) -> None:
    """Ranked rows as CSV with a header, in board order."""
    board.orderBy("position").write.mode("errorifexists").option("header", True).csv(path)
