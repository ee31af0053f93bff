"""Quotation linking for chat data.

Lines that begin with `>` are quoted, one level for each mark. Quoted passages are hashed after
normalising and joined to the messages that first said them; a message answers the one whose words
it quotes at its lowest quote level. A passage that nobody said as it stands (a trimmed quote) is
linked by the runs of three words it shares with one earlier turn. Conversations come out as threads without quotes, messages
ordered by thread and turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.scale import last_known
from engramlake.llm.store import written

MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: The line that mail programs put above a quote.
ATTRIBUTION = re.compile(r"^.{0,200}\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$")
MIN_WORDS = 3


def parse(text: str | None) -> list[tuple[int, str]]:
    """Passages (quote level, text) of a message: consecutive lines of one level. Null has none."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        level, rest = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if level and out and out[-1][0] < level and out[-1][1] and ATTRIBUTION.match(out[-1][1][-1]):
            out[-1][1].pop()
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    return [(level, "\n".join(lines)) for level, lines in out if lines]


def passage_hash(text: str) -> str | None:
    """Hash of the words of a passage in lower case; null without words, and marked for fewer than ``MIN_WORDS`` words."""
    words = text.lower().split()
    mark = "" if len(words) >= MIN_WORDS else "short:"
    return mark + hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest() if words else None


def units(text: str) -> set[str]:
    """Hashes under which a message's own words can be quoted: all of them, each paragraph, each line."""
    parts = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
    return {h for p in parts if (h := passage_hash(p))}


def shingles(text: str | None) -> list[int]:
    """Hashes of the distinct runs of ``MIN_WORDS`` words."""
    words = [w.encode("utf-8", "surrogatepass") for w in (text or "").lower().split()]
    runs = {b" ".join(words[i : i + MIN_WORDS]) for i in range(len(words) - MIN_WORDS + 1)}
    return sorted(xxhash.xxh64_intdigest(r) - (1 << 63) for r in runs)


def _parsed(rows: DataFrame) -> DataFrame:
    """conv, turn, own, quotes (level, hash, grams), said (hashes of the own words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quote = pa.struct([("level", pa.int32()), ("hash", pa.string()), ("grams", pa.list_(pa.int64()))])
        for b in batches:
            own, quotes, said = [], [], []
            for text in b.column(2).to_pylist():
                parts = parse(text)
                mine = "\n".join(p for level, p in parts if level == 0)
                own.append(None if text is None else re.sub(r"\n{3,}", "\n\n", mine).strip("\n"))
                quotes.append([{"level": level, "hash": h, "grams": shingles(p)} for level, p in parts if level for h in [passage_hash(p)] if h])
                said.append(sorted(set().union(*(units(p) for level, p in parts if level == 0), units(mine))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(own, pa.string()), pa.array(quotes, pa.list_(quote)), pa.array(said, pa.list_(pa.string()))],
                ["conv", "turn", "own", "quotes", "said"],
            )

    kind = rows.schema["conv"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv {kind}, turn long, own string, quotes array<struct<level:int,hash:string,grams:array<bigint>>>, said array<string>")


def _trimmed(keyed: DataFrame, missing: DataFrame) -> DataFrame:
    """conv, turn, level, hash, near of the ``missing`` passages that share over half of their runs of words with
    one earlier turn: the one that shares most, the latest of equals.

    Passages and turns of equal runs are classes, so copies are compared once. A turn that shares over
    half of a passage's runs shares one of its rarest half: only those look for classes to compare.
    """
    passage = ["conv", "turn", "level", "hash"]
    quoted = keyed.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.level", "q.hash", "q.grams")
    quoted = written(quoted.join(missing, passage, "left_semi"), "quotes-missing")
    wanted = written(quoted.select("conv", "hash", F.explode("grams").alias("gram")).distinct(), "quote-grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [shingles(t) for t in b.column(2).to_pylist()]
            cls = pa.array([hashlib.md5(np.array(g, np.int64).tobytes()).hexdigest() for g in grams], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cls, pa.array(grams, pa.list_(pa.int64()))], ["conv", "turn", "cls", "grams"])

    kind = keyed.schema["conv"].dataType.simpleString()
    told = keyed.select("conv", "turn", "own").join(missing.select("conv").distinct(), "conv", "left_semi")
    told = told.mapInArrow(run, f"conv {kind}, turn long, cls string, grams array<long>").where(F.size("grams") > 0)
    told = written(told.select("conv", "turn", "cls", F.explode("grams").alias("gram")).join(wanted.select("conv", "gram").distinct(), ["conv", "gram"], "left_semi"), "said-grams")
    turns = told.select("conv", "cls", "turn").distinct()
    told = written(told.select("conv", "cls", "gram").distinct(), "said-classes")
    often = told.groupBy("conv", "gram").agg(F.count("*").alias("often"))
    one = Window.partitionBy("conv", "hash")
    ranked = wanted.join(often, ["conv", "gram"], "left").withColumn("rank", F.row_number().over(one.orderBy(F.coalesce("often", F.lit(0)), "gram")))
    ranked = ranked.withColumn("of", F.count("*").over(one))
    rare = ranked.where(F.col("rank") <= F.ceil(F.col("of") / 2)).select("conv", "hash", "gram", "of")
    some = rare.join(told, ["conv", "gram"]).select("conv", "hash", "of", "cls").distinct()
    shared = some.join(wanted, ["conv", "hash"]).join(told, ["conv", "cls", "gram"]).groupBy("conv", "hash", "of", "cls").agg(F.count("*").alias("n"))
    shared = shared.where("2 * n > of").select("conv", "hash", "cls", "n")
    asks = quoted.select(*passage).distinct().join(shared, ["conv", "hash"])
    # of one turn, what it quotes comes before what it says
    none = F.lit(None)
    both = asks.select("conv", "cls", (2 * F.col("turn")).alias("seq"), none.cast("long").alias("at"), "turn", "level", "hash", "n")
    both = both.unionByName(
        turns.select(
            "conv", "cls", (2 * F.col("turn") + 1).alias("seq"), F.col("turn").alias("at"), none.cast("long").alias("turn"), none.cast("int").alias("level"),
            none.cast("string").alias("hash"), none.cast("long").alias("n"),
        )
    )
    found = last_known(both, ["conv", "cls"], "seq", {"origin": F.col("at")}).where("hash is not null and origin is not null")
    return found.groupBy(*passage).agg(F.max(F.struct("n", "origin")).alias("best")).select(*passage, F.col("best.origin").alias("near"))


def link_quotes(
    messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(parsed messages, links). A link: conv, turn, level, hash, origin: the latest earlier turn of the
    conversation that says the passage in its own words, or else shares most of it; null where none does.
    A passage of one or two words counts only where just one earlier turn says it."""
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"))
    parsed = written(_parsed(rows), "messages")
    keyed = parsed.where("conv is not null and turn is not null")
    asked = keyed.select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", F.col("q.level").alias("level"), F.col("q.hash").alias("hash"))
    asked = written(asked.distinct(), "quotes")
    said = keyed.select("conv", "turn", F.explode("said").alias("hash"))
    said = written(said.join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi").distinct(), "said")
    # as-of match: of one turn, what it quotes comes before what it says
    both = asked.select("conv", "hash", (2 * F.col("turn")).alias("seq"), F.lit(None).cast("long").alias("at"), "level")
    both = both.unionByName(said.select("conv", "hash", (2 * F.col("turn") + 1).alias("seq"), F.col("turn").alias("at"), F.lit(None).cast("int").alias("level")))
    found = last_known(both, ["conv", "hash"], "seq", {"origin": F.col("at")}).where("level is not null")
    found = found.select("conv", (F.col("seq") / 2).cast("long").alias("turn"), "level", "hash", "origin")
    first = said.groupBy("conv", "hash").agg(F.min("turn").alias("first"))
    short = F.col("hash").startswith("short:")
    found = found.join(first, ["conv", "hash"], "left").where(~short | F.coalesce(F.col("origin") == F.col("first"), F.lit(False))).drop("first")
    found = written(found, "quotes-as-said")
    near = _trimmed(keyed, found.where("origin is null").select("conv", "turn", "level", "hash"))
    found = found.join(near, ["conv", "turn", "level", "hash"], "left")
    return parsed, found.select("conv", "turn", "level", "hash", F.coalesce("origin", "near").alias("origin"))


def threads(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conv, turn, own, n_quotes, n_linked, reply_to, thread, depth: a row for each row of ``messages``.

    ``own`` is the text without quotes and attribution lines. ``reply_to`` is the turn quoted at the
    lowest linked level (the latest of several), null where nothing links. ``thread`` is the turn
    that begins the chain of replies, ``depth`` the replies from there; the reply order of a
    conversation is (thread, turn). Messages without conversation or turn keep their text, stripped
    of quotes, and link to nothing (thread: their own turn); a null text stays null. Rows that repeat
    a turn share its links.
    """
    parsed, links = link_quotes(messages, conv_col=conv_col, turn_col=turn_col, text_col=text_col)
    links = written(links, "quote-links")
    each = links.groupBy("conv", "turn").agg(
        F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"),
        F.min(F.when(F.col("origin").isNotNull(), F.struct("level", (-F.col("origin")).alias("o")))).alias("best"),
    )
    each = written(each.withColumn("reply_to", -F.col("best.o")).drop("best"), "replies")
    hop = written(each.where("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth")), "chain")
    while True:
        # pointer doubling: each round doubles the replies a pointer spans
        above = hop.select("conv", F.col("turn").alias("up"), F.col("up").alias("upper"), F.col("depth").alias("more"))
        new = hop.join(above, ["conv", "up"], "left").select(
            "conv", "turn", F.coalesce("upper", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("upper").isNotNull().alias("moved")
        )
        new = written(new, "chain")
        hop = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    out = parsed.join(each, ["conv", "turn"], "left").join(hop, ["conv", "turn"], "left")
    zero = F.lit(0)
    return out.select(
        "conv", "turn", "own", F.coalesce("n_quotes", zero).cast("long").alias("n_quotes"), F.coalesce("n_linked", zero).cast("long").alias("n_linked"),
        "reply_to", F.coalesce("up", "turn").alias("thread"), F.coalesce("depth", zero).cast("long").alias("depth"),
    )
