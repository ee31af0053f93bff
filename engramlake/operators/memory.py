"""Memory store and retrieval: containment, BM25, vectors, rank fusion, budgets and replay."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import answers as A
from engramlake.functions.scale import distributed_rank, running_sum, top_k
from engramlake.functions.text import contains_pairs, exploded, normal_topic, words
from engramlake.operators.entity import format_value
from engramlake.session import materialise, sized

# Okapi parameters, fusion weights and constant, decay per write, limits.
K1, B = 1.5, 0.75
RRF_K, W_VECTOR, W_KEYWORD = 60, 0.7, 0.3
DECAY = 0.99
MAX_CONTENT_CHARS = 2000


# --- which entities are stored ------------------------------------------------------------------


def plain_number(v: Column) -> Column:
    """A double the way a log prints it: at least one decimal, no trailing zeros (cents precision)."""
    cents = F.regexp_replace(F.format_string("%.2f", v), "0$", "")
    return F.when(v == F.round(v, 2), cents).otherwise(v.cast("string"))


def value_variants(long: DataFrame, attr_def: DataFrame, keys: Sequence[str] = ("world_id", "entity")) -> DataFrame:
    """Texts under which an attribute value may appear in an entry (lower case, no commas).

    Formatted, raw, rounded to an int, to one decimal, to none. At most a handful per attribute.
    """
    d = long.drop("dtype").join(F.broadcast(attr_def.select("attr", "dtype", "unit", "label")), "attr")
    num, dtype = F.col("num"), F.col("dtype")
    shown = F.replace(F.lower(format_value(num, F.col("str"), F.col("dt"), dtype, F.col("unit"))), F.lit(","), F.lit(""))
    whole = F.rint(num).cast("bigint").cast("string")
    variants = (
        F.when(dtype == "int", F.array(shown, whole))
        .when(dtype == "float", F.array(
            shown, plain_number(num), whole, F.format_string("%.1f", num), F.format_string("%.0f", num)))
        .when(dtype == "date", F.array(shown, F.col("dt").cast("string")))
        .otherwise(F.array(shown, F.lower("str")))
    )
    return d.select(*keys, "attr", "label", F.array_distinct(variants).alias("variants"))


def series_variants(series: Column) -> Column:
    """Variants of a series attribute: each of its points."""
    return F.array_distinct(F.transform(series, plain_number))


def _says(text: Column, variants: Column) -> Column:
    return F.exists(variants, lambda v: F.contains(text, v))


def name_value_hits(entities: DataFrame, variants: DataFrame, entries: DataFrame, scope: Sequence[str] = ("world_id",)) -> DataFrame:
    """(scope, entity, entry_id, has_value) for every entry naming the entity.

    ``entities``: scope, entity. ``variants``: scope, entity, variants (one row per attribute).
    ``entries``: scope, entry_id, content.
    """
    scope = list(scope)
    # names and values meet by grouping: no side of a join could be sent to the driver
    none = F.lit(None).cast(variants.schema["variants"].dataType)
    both = entities.select(*scope, "entity", F.lit(True).alias("__asked"), none.alias("variants")).unionByName(
        variants.select(*scope, "entity", F.lit(False).alias("__asked"), "variants")
    )
    names = both.groupBy(*scope, "entity").agg(F.flatten(F.collect_list("variants")).alias("__known"), F.bool_or("__asked").alias("__asked"))
    names = names.where("__asked").select(*scope, "entity", F.col("entity").alias("__name"), "__known")
    names = sized(materialise(names, "names"))  # read by several branches
    hits = contains_pairs(
        names, entries, scope=scope, needle_id="entity", needle="__name", doc_id="entry_id", text="content", also="__known"
    )
    return hits.withColumnRenamed("has_also", "has_value")


def detect_stored_entities(entities: DataFrame, variants: DataFrame, entries: DataFrame, scope: Sequence[str] = ("world_id",)) -> DataFrame:
    """Every entity with ``stored``: its name and one of its values occur in the same entry."""
    hits = name_value_hits(entities, variants, entries, scope).where("has_value").select(*scope, "entity").distinct()
    return entities.select(*scope, "entity").distinct().join(
        hits.withColumn("__hit", F.lit(True)), [*scope, "entity"], "left"
    ).select(*scope, "entity", F.coalesce("__hit", F.lit(False)).alias("stored"))


def missed_entities(stored: DataFrame) -> DataFrame:
    return stored.where(~F.col("stored")).drop("stored")


def storage_coverage(stored: DataFrame, scope: Sequence[str] = ("world_id",)) -> DataFrame:
    return stored.groupBy(*scope).agg(
        F.count_if("stored").alias("n_stored"), F.count(F.lit(1)).alias("n_entities"),
        F.avg(F.col("stored").cast("int")).alias("coverage"),
    )


def noise_documents(entities: DataFrame, variants: DataFrame, entries: DataFrame, scope: Sequence[str] = ("world_id",)) -> DataFrame:
    """Entries that name entities but carry none of their values."""
    return name_value_hits(entities, variants, entries, scope).groupBy(*scope, "entry_id").agg(
        F.count(F.lit(1)).alias("n_mentioned"), F.bool_or("has_value").alias("__v")
    ).where(~F.col("__v")).drop("__v")


# --- keyword and vector search ------------------------------------------------------------------


def bm25_scores(queries: DataFrame, entries: DataFrame, scope: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Positive Okapi scores (scope, query_id, entry_id, score).

    ``queries``: scope, query_id, text. ``entries``: scope, entry_id, content. Only words that some query
    of the scope asks for are counted, so the big word table never reaches a shuffle.
    """
    scope = list(scope)
    asked = exploded(queries, [*scope, "query_id"], words(F.col("text")), "tok").groupBy(
        *scope, "query_id", "tok"
    ).agg(F.count(F.lit(1)).alias("qtf"))
    doc = entries.select(*scope, "entry_id", words(F.col("content")).alias("__w"))
    stats = doc.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("__w")).alias("avgdl"))
    tf = (
        exploded(doc, [*scope, "entry_id", F.size("__w").alias("dl")], F.col("__w"), "tok")
        .join(asked.select(*scope, "tok").distinct(), [*scope, "tok"], "left_semi")
        .groupBy(*scope, "entry_id", "dl", "tok").agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy(*scope, "tok").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(stats, scope).select(
        *scope, "tok", "avgdl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    terms = asked.join(idf, [*scope, "tok"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    )
    return tf.join(terms, [*scope, "tok"]).groupBy(*scope, "query_id", "entry_id").agg(F.sum(part).alias("score"))


def dot(a: str, b: str, dims: int) -> Column:
    """Dot product of two array columns of ``dims`` elements; null where either has another length or a null.

    One expression for any number of elements, summed pairwise, which keeps the expression tree shallow.
    """
    parts = [f"double(get({a}, {i})) * double(get({b}, {i}))" for i in range(dims)]
    while len(parts) > 1:
        parts = [f"({' + '.join(parts[i:i + 2])})" for i in range(0, len(parts), 2)]
    return F.when((F.size(a) == dims) & (F.size(b) == dims), F.expr(parts[0]))


def vector_scores(queries: DataFrame, entries: DataFrame, dims: int, scope: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Cosine of each query with every entry of its scope.

    Norms are computed once per vector before the join. ``queries``: scope, query_id, qvec;
    ``entries``: scope, entry_id, embedding.
    """
    scope = list(scope)
    q = queries.select(*scope, "query_id", "qvec", F.sqrt(dot("qvec", "qvec", dims)).alias("__qn"))
    e = entries.select(*scope, "entry_id", "embedding", F.sqrt(dot("embedding", "embedding", dims)).alias("__en"))
    sim = F.try_divide(dot("qvec", "embedding", dims), F.col("__qn") * F.col("__en"))
    return e.join(q, scope).select(*scope, "query_id", "entry_id", F.coalesce(sim, F.lit(0.0)).alias("score"))


def vector_topk(queries: DataFrame, entries: DataFrame, k: int, dims: int, scope: Sequence[str] = ("agent_id",)) -> DataFrame:
    scores = vector_scores(queries, entries, dims, scope)
    return top_k(scores, [*scope, "query_id"], [F.col("score").desc(), F.col("entry_id")], k, "rank")


def rrf_fuse(ranked_vector: DataFrame, ranked_keyword: DataFrame, keys: Sequence[str]) -> DataFrame:
    """0.7 / (60 + vector rank) + 0.3 / (60 + keyword rank); a list without the entry adds nothing."""
    v = ranked_vector.select(*keys, F.col("rank").alias("rank_vec"))
    b = ranked_keyword.select(*keys, F.col("rank").alias("rank_bm25"))
    part = lambda w, r: F.coalesce(w / (RRF_K + F.col(r)), F.lit(0.0))
    return v.join(b, list(keys), "full_outer").withColumn(
        "rrf", part(W_VECTOR, "rank_vec") + part(W_KEYWORD, "rank_bm25")
    )


def recency_decay(scored: DataFrame, seqs: DataFrame, scope: Sequence[str], score: str = "rrf", out: str = "score") -> DataFrame:
    """score x 0.99 ^ (latest write of the scope - write of the entry). ``seqs``: scope, entry_id, seq."""
    scope = list(scope)
    latest = seqs.groupBy(*scope).agg(F.max("seq").alias("__max"))
    aged = seqs.join(latest, scope).select(*scope, "entry_id", (F.col("__max") - F.col("seq")).alias("__age"))
    return scored.join(aged, [*scope, "entry_id"]).withColumn(
        out, F.col(score) * F.pow(F.lit(DECAY), F.col("__age"))
    ).drop("__age")


def fused_ranks(
    queries: DataFrame, entries: DataFrame, dims: int, scope: Sequence[str] = ("agent_id",), *, digits: int | None = None
) -> DataFrame:
    """Full vector and keyword ranks of every entry of the query's scope, fused: a row for each pair.

    An entry without an embedding has its keyword rank only. With ``digits``, scores that round to the
    same number tie. For the best entries alone, ``hybrid.hybrid_search`` needs no such table.
    """
    scope = list(scope)
    keys = [*scope, "query_id"]
    vec = vector_scores(queries, entries.where("embedding is not null"), dims, scope)
    words_score = bm25_scores(queries, entries, scope)
    all_pairs = entries.select(*scope, "entry_id").join(queries.select(*keys), scope)
    keyword = all_pairs.join(words_score, [*keys, "entry_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    score = F.col("score") if digits is None else F.round("score", digits)
    rv = distributed_rank(vec.withColumn("score", score), keys, "score", "entry_id")
    rb = distributed_rank(keyword.withColumn("score", score), keys, "score", "entry_id")
    return rrf_fuse(rv, rb, [*keys, "entry_id"])


def entry_name(content: Column) -> Column:
    """Lower-cased text before the first `` | ``."""
    return F.lower(A.strip(F.substring_index(content, " | ", 1)))


def name_priority_rerank(queries: DataFrame, entries: DataFrame, ranked: DataFrame, k: int, scope: Sequence[str] = ("world_id",)) -> DataFrame:
    """Order by match class, then vector rank.

    Class 0: the entry's name is the query; 1: one contains the other; 2: the query occurs in the entry;
    3: found by vector only. ``ranked`` is the vector pool (scope, query_id, entry_id, rank), taken 3k deep;
    textual hits outside of it come after the pool in order of their ids.
    """
    scope = list(scope)
    keys = [*scope, "query_id"]
    q = queries.select(*keys, F.lower(A.strip("text")).alias("__q"))
    e = entries.select(*scope, "entry_id", "content", entry_name(F.col("content")).alias("__name"))
    in_content = contains_pairs(
        q, e, scope=scope, needle_id="query_id", needle="__q", doc_id="entry_id", text="content"
    )
    in_query = contains_pairs(
        e.select(*scope, "entry_id", "__name"), q, scope=scope, needle_id="entry_id", needle="__name",
        doc_id="query_id", text="__q",
    ).select(*keys, "entry_id")
    pool = ranked.where(F.col("rank") <= 3 * k).select(*keys, "entry_id", "rank")
    hits = in_content.unionByName(in_query).distinct().join(pool, [*keys, "entry_id"], "left_anti")
    both = pool.unionByName(hits.withColumn("rank", F.lit(None).cast("int")))
    d = both.join(q, keys).join(e, [*scope, "entry_id"])
    name, text = F.col("__name"), F.col("__q")
    cls = (
        F.when(name == text, 0)
        .when(F.contains(name, text) | F.contains(text, name), 1)
        .when(F.contains(F.lower("content"), text), 2)
        .otherwise(3)
    )
    d = d.select(*keys, "entry_id", cls.alias("match_class"), "rank")
    return top_k(
        d, keys, [F.col("match_class"), F.col("rank").asc_nulls_last(), F.col("entry_id")], k, "position"
    )


# --- key-value content --------------------------------------------------------------------------


def extract_kv(df: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """``label: value | ...`` to one row per pair."""
    part = F.col("__part")
    return df.select(*keys, F.explode(F.split(content, r"\|")).alias("__part")).where(F.contains(part, F.lit(":"))).select(
        *keys,
        F.lower(A.strip(F.substring_index(part, ":", 1))).alias("label"),
        A.strip(F.substr(part, F.instr(part, F.lit(":")) + 1)).alias("value"),
    ).where((F.col("label") != "") & (F.col("value") != ""))


def label_matches(label: Column, asked: Column) -> Column:
    """Either label contains the other, ignoring case."""
    a, b = F.lower(label), F.lower(asked)
    return F.contains(a, b) | F.contains(b, a)


def retrieval_quality(entities: DataFrame, results: DataFrame, variants: DataFrame, questions: DataFrame,
                      scope: Sequence[str] = ("world_id",), depth: int = 3) -> DataFrame:
    """Per world: recall by name in the top 3, values preserved in the top 1, questions answerable.

    ``results``: scope, entity (the query), rank, content. ``questions``: scope, question_id, entity, label,
    truth, competency. A question counts when a top-3 entry naming the entity holds the truth text or a value
    under a matching label that grades as correct.
    """
    scope = list(scope)
    top = results.where(F.col("rank") <= depth)
    named = F.contains(F.lower("content"), F.lower("entity"))
    found = top.groupBy(*scope, "entity").agg(F.bool_or(named).alias("__hit"))
    recall = entities.select(*scope, "entity").distinct().join(found, [*scope, "entity"], "left").groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_entities"), F.avg(F.coalesce("__hit", F.lit(False)).cast("int")).alias("recall")
    )
    first = results.where(F.col("rank") == 1).select(*scope, "entity", F.replace(F.lower("content"), F.lit(","), F.lit("")).alias("__t"))
    kept = first.join(variants, [*scope, "entity"]).groupBy(*scope).agg(
        F.avg(_says(F.col("__t"), F.col("variants")).cast("int")).alias("preservation")
    )
    named_top = top.where(named).select(*scope, "entity", "rank", "content")
    asked = questions.join(named_top, [*scope, "entity"], "left")
    direct = F.contains(F.replace(F.col("content"), F.lit(","), F.lit("")), F.col("truth"))
    # the pairs of one entry are few, so they are graded inside the row
    parts = F.filter(F.split("content", r"\|"), lambda p: F.contains(p, F.lit(":")))

    def good(p: Column) -> Column:
        label = A.strip(F.substring_index(p, ":", 1))
        value = A.strip(F.substr(p, F.instr(p, F.lit(":")) + 1))
        return label_matches(label, F.col("label")) & (
            (F.lower(value) == F.lower("truth")) | A.numeric_match(value, F.col("truth"))
        )

    ok = F.coalesce(direct | F.exists(parts, good), F.lit(False))
    answered = asked.groupBy(*scope, "question_id").agg(F.bool_or(ok).alias("__ok"))
    accuracy = answered.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_questions"), F.avg(F.col("__ok").cast("int")).alias("accuracy")
    )
    return recall.join(kept, scope, "left").join(accuracy, scope, "left")


# --- budgets, replay, upserts -------------------------------------------------------------------


def enforce_write_budget(ops: DataFrame, keys: Sequence[str], seq: str, budget: int, chunk_rows: int = 1_000_000) -> DataFrame:
    """Verdict per logged operation under a write budget.

    ``ops``: tool, n_chars, ok (the edit found its text), free (during a correction). Each accepted write or
    successful edit costs one unit; over-long writes and failed edits cost nothing.
    """
    write = F.col("tool").isin("Write", "memory_store")
    edit = (F.col("tool") == "Edit") & ~F.col("free")
    too_long = write & (F.col("n_chars") > MAX_CONTENT_CHARS)
    cost = F.when((write & ~too_long) | (edit & F.col("ok")), 1).otherwise(0)
    d = running_sum(ops, keys, seq, {"__before": cost}, inclusive=False, chunk_rows=chunk_rows)
    left = F.col("__before") < budget
    return d.select(
        *ops.columns,
        F.when(too_long, "too_long")
        .when((write | edit) & ~left, "rejected")
        .when(edit & ~F.col("ok"), "refunded")
        .when(write | (F.col("tool") == "Edit"), "accepted")
        .otherwise("free").alias("verdict"),
        F.greatest(F.lit(budget) - F.col("__before") - F.when(left, cost).otherwise(0), F.lit(0)).cast("bigint").alias("remaining"),
    )


REPLAY_SCHEMA = "agent_id bigint, position bigint, topic string, content string, writes_used bigint"


def _text(value: object) -> str:
    return value.strip() if isinstance(value, str) else ""


class Store:
    """One agent's entries: for each topic the contents by slot, slots numbered in order of arrival."""

    def __init__(self, entries: Sequence[tuple[str, str]] = (), used: int = 0) -> None:
        self.by_topic: dict[str, dict[int, str]] = {}
        self.arrived, self.used = 0, used
        for topic, content in entries:
            self.put(topic, content)

    def put(self, topic: str, content: str) -> None:
        self.by_topic.setdefault(topic, {})[self.arrived] = content
        self.arrived += 1

    def entries(self) -> list[tuple[str, str]]:
        rows = sorted((slot, topic, c) for topic, held in self.by_topic.items() for slot, c in held.items())
        return [(topic, c) for _, topic, c in rows]

    def step(self, row, budget: int, free_replace: bool) -> None:
        """One operation; what would change nothing costs nothing, and nothing that costs happens without budget."""
        costs = row.action == "add" or not free_replace
        if not (costs and self.used >= budget) and self._change(row.action, row.topic, _text(row.content), _text(row.old_text)):
            self.used += costs

    def _change(self, action: str, topic: str, content: str, old: str) -> bool:
        held = self.by_topic.get(topic, {})
        if action == "add":
            fits = bool(content) and content not in held.values()
            if fits:
                self.put(topic, content)
            return fits
        named = {slot: c for slot, c in held.items() if old in c}
        if len(set(named.values())) != 1 or (action == "replace" and not content):
            return False  # nothing is meant, or several different entries are
        slot = min(named)
        if action == "replace":
            held[slot] = content
        else:
            del held[slot]
        return True


ACTIONS = ("add", "replace", "remove")


def memory_actions(ops: DataFrame) -> DataFrame:
    """Operations that succeeded and mean the agent's memory: a ``target`` that is given must be ``memory``."""
    meant = F.coalesce(F.col("target"), F.lit("memory")) == "memory" if "target" in ops.columns else F.lit(True)
    return ops.where(F.col("ok") & F.col("action").isin(*ACTIONS) & meant).select(
        "agent_id", "seq", "action", normal_topic(F.col("topic")).alias("topic"), "content", "old_text"
    )


def replay_memory(ops: DataFrame, budget: int, *, initial: DataFrame | None = None, free_replace: bool = False) -> DataFrame:
    """Replay add / replace / remove per agent under the budget and return the final entries.

    ``ops``: agent_id, seq, action, topic, content, old_text, ok and, if wanted, target. ``initial``: agent_id, seq,
    topic, content of the entries that stand before the first operation, in ``seq`` order; they cost nothing, and
    agents that have only these keep them. Agents left without entries give no row.

    Each step depends on all before it, so an agent is one ordered stream: rows are partitioned by agent, sorted by
    (agent, initial first, seq) and folded batch by batch. A task holds one agent's entries (the initial ones and at
    most the budget) and one Arrow batch, whatever the length of the stream.
    """
    acts = memory_actions(ops).withColumn("stage", F.lit(1))
    if initial is not None:
        given = initial.select("agent_id", "seq", F.lit("given").alias("action"), "topic", "content", F.lit(0).alias("stage"))
        acts = acts.unionByName(given, allowMissingColumns=True)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent, store = None, Store()

        def flush() -> Iterator[pd.DataFrame]:
            entries = store.entries()
            if entries:
                yield pd.DataFrame({
                    "agent_id": [agent] * len(entries), "position": range(len(entries)), "topic": [t for t, _ in entries],
                    "content": [c for _, c in entries], "writes_used": [store.used] * len(entries),
                })

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.agent_id != agent:
                    yield from flush()
                    agent, store = row.agent_id, Store()
                if row.action == "given":
                    store.put(row.topic, row.content)
                else:
                    store.step(row, budget, free_replace)
        yield from flush()

    return acts.repartition("agent_id").sortWithinPartitions("agent_id", "stage", "seq").mapInPandas(fold, REPLAY_SCHEMA)


def upsert_entries(ops: DataFrame, keys: Sequence[str] = ("agent_id", "entry_id")) -> DataFrame:
    """Latest write per entry id; entries whose latest operation is a forget are gone.

    ``ops``: keys, seq, op ('upsert' or 'forget'), content.
    """
    last = ops.groupBy(*keys).agg(F.max_by(F.struct("op", "content", "seq"), "seq").alias("x"))
    return last.where(F.col("x.op") == "upsert").select(*keys, F.col("x.seq").alias("seq"), F.col("x.content").alias("content"))


def edit_entries(entries: DataFrame, edits: DataFrame, keys: Sequence[str] = ("agent_id", "entry_id")) -> DataFrame:
    """Replace the first occurrence of ``old_text`` in the entry; a changed entry gets the edit's seq.

    ``edits``: keys (one row each), old_text, new_text, edit_seq.
    """
    j = entries.join(edits, list(keys), "left")
    at = F.instr(F.col("content"), F.col("old_text"))
    hit = F.coalesce((at > 0) & (F.col("old_text") != ""), F.lit(False))
    changed = F.overlay(F.col("content"), F.col("new_text"), at, F.length("old_text"))
    return j.select(
        *keys, F.when(hit, F.col("edit_seq")).otherwise(F.col("seq")).alias("seq"),
        F.when(hit, changed).otherwise(F.col("content")).alias("content"), hit.alias("edited"),
    )


def memory_inventory(entries: DataFrame, budget: int, writes: DataFrame, agent: str = "agent_id", n_names: int = 30) -> DataFrame:
    """Entries per agent, the first 30 names and the budget left. ``writes``: agent, writes_used."""
    name = A.strip(F.substring_index("content", "|", 1))
    first = top_k(entries.select(agent, "seq", name.alias("__n")), [agent], [F.col("seq")], n_names, "__rn")
    names = first.groupBy(agent).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "__n"))), lambda x: x["__n"]), "; ").alias("names")
    )
    counts = entries.groupBy(agent).agg(F.count(F.lit(1)).alias("n_entries"))
    left = F.greatest(F.lit(budget) - F.coalesce("writes_used", F.lit(0)), F.lit(0))
    return counts.join(names, agent).join(writes, agent, "left").select(agent, "n_entries", "names", left.alias("remaining"))
