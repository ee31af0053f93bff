"""Tokenising and containment search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from engramlake.functions.answers import strip
from engramlake.session import materialise, sized

# Letters, digits and underscore of any script; the same pattern runs on RE2 engines.
WORD = r"[\p{L}\p{N}_]+"

# A run of word characters, or of signs: neither white space nor word characters.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"

GRAM = 6
MOST_NEEDLES = 50_000  # of one document in an automaton
FEW = 16  # so many needles are looked for one by one
COMMON = 1_000  # most frequent pieces that a join may leave out


def words(text: Column) -> Column:
    """Lower-cased word tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def exploded(df: DataFrame, keep: Sequence[str | Column], items: Column, out: str) -> DataFrame:
    """One row per array element.

    An inner explode makes the optimizer add a ``size(items) > 0`` filter, which it pushes below the
    projection and so evaluates costly arrays again; the outer form with a filter behind it does not.
    """
    return df.select(*keep, F.explode_outer(items).alias(out)).where(F.col(out).isNotNull())


def normal_topic(topic: Column) -> Column:
    """Lower case, letters, digits, underscore and hyphen only; nothing left means ``general``."""
    t = strip(F.coalesce(topic, F.lit("")))
    cleaned = F.regexp_replace(F.lower(t), "[^a-z0-9_-]+", "")
    return F.when(t == "core", t).when(cleaned == "", "general").otherwise(cleaned)


def pieces(text: Column) -> Column:
    """Lower-cased runs of word characters and of signs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0))


def contains_pairs(
    needles: DataFrame,
    docs: DataFrame,
    *,
    scope: Sequence[str],
    needle_id: str,
    needle: str,
    doc_id: str,
    text: str,
    also: str | None = None,
) -> DataFrame:
    """(scope, needle_id, doc_id) where the document text contains the needle, ignoring case.

    Exact, also where the needle sits inside longer words, and without comparing all pairs: a text
    that contains the needle has a piece (a run of word characters, or of signs) that contains any
    given piece of the needle. So each needle is anchored on its rarest piece, the anchor is expanded
    to the vocabulary pieces containing it (found by its first characters, on distinct pieces only),
    and only documents with one of those are checked. A needle without a piece (white
    space, or nothing) is checked against every document of its scope.

    A text with many candidates is read once for all of them (see ``_search``). With
    ``also``, an array of lower-case texts beside each needle, the result has ``has_also``: the
    document, without its commas, holds one of them. Null needles, ids and texts find nothing.
    """
    scope = list(scope)
    needles = needles.where(F.col(needle).isNotNull())
    own_pieces = F.concat(F.array_distinct(pieces(F.col(text))), F.array(F.lit("")))
    posting = exploded(docs, [*scope, doc_id], own_pieces, "__tok")
    vocab = sized(materialise(posting.groupBy(*scope, "__tok").agg(F.count(F.lit(1)).alias("__df")), "vocabulary"))
    found = F.array_distinct(pieces(F.col(needle)))
    asked = exploded(needles, [*scope, needle_id], F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))), "__tok")
    # Anchor: the needle's piece in the fewest documents (none at all is best), the longer one on ties.
    rarity = F.struct(F.coalesce("__df", F.lit(0)), -F.length("__tok"), F.col("__tok"))
    anchor = materialise(
        asked.join(vocab, [*scope, "__tok"], "left").groupBy(*scope, needle_id).agg(F.min_by("__tok", rarity).alias("__anchor")), "anchors"
    )
    anchors = sized(anchor)

    # Where an anchor may begin in a piece of the vocabulary: each place asks, by the characters that follow, which
    # lengths anchors of that beginning have, and looks up exactly those substrings.
    sizes = sorted(r.n for r in anchor.select(F.least(F.lit(GRAM), F.length("__anchor")).alias("n")).where("n > 0").distinct().collect())
    lengths = sized(materialise(anchor.where("__anchor != ''").groupBy(*scope, F.substr("__anchor", F.lit(1), F.lit(GRAM)).alias("__gram")).agg(
        F.collect_set(F.length("__anchor")).alias("__lengths")
    ), "lengths"))

    def places(n: int) -> Column:
        last = F.length("__tok") - n + 1
        each = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(i.alias("at"), F.substr(F.col("__tok"), i, F.lit(n)).alias("gram")))
        return F.when(last >= 1, each).otherwise(F.array().cast("array<struct<at: int, gram: string>>"))

    begun = exploded(vocab, [*scope, "__tok"], F.concat(*[places(n) for n in sizes]), "__place") if sizes else None
    whole = anchor.where("__anchor = ''").select(*scope, needle_id, F.col("__anchor").alias("__tok"))
    if begun is not None:
        begun = begun.select(*scope, "__tok", F.col("__place.at").alias("__at"), F.col("__place.gram").alias("__gram")).join(lengths, [*scope, "__gram"])
        fits = F.filter("__lengths", lambda n: n <= F.length("__tok") - F.col("__at") + 1)
        wider = exploded(begun, [*scope, "__tok", "__at"], fits, "__n").select(*scope, "__tok", F.substr("__tok", F.col("__at"), F.col("__n")).alias("__anchor"))
        whole = whole.unionByName(anchors.join(wider, [*scope, "__anchor"]).select(*scope, needle_id, "__tok"))
    targets = sized(materialise(whole, "targets"))
    # frequent pieces that no needle is anchored on stay out of the join
    common = vocab.orderBy(F.col("__df").desc()).limit(COMMON).join(targets, [*scope, "__tok"], "left_anti").select(*scope, "__tok")
    pairs = targets.join(posting.join(F.broadcast(common), [*scope, "__tok"], "left_anti"), [*scope, "__tok"]).select(*scope, needle_id, doc_id).distinct()
    return _search(pairs, needles, docs, scope, needle_id, needle, doc_id, text, also)


def _search(
    pairs: DataFrame, needles: DataFrame, docs: DataFrame, scope: list[str], needle_id: str, needle: str, doc_id: str, text: str, also: str | None
) -> DataFrame:
    """The candidate ``pairs`` whose text does contain the needle, each once.

    A text with at most ``FEW`` candidates is searched for each of them. Other texts and their candidates
    are dealt by document and sorted, the text first: a task holds one document's texts and at most
    ``MOST_NEEDLES`` of its candidates, makes an automaton of them and reads the text once.
    """
    key = [*scope, doc_id]
    asked = needles.select(*scope, needle_id, F.lower(needle).alias("__says"), (F.col(also) if also else F.array()).cast("array<string>").alias("__also"))
    counted = sized(materialise(pairs.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key))), "candidates"))
    few, many = (counted.where(c).drop("__n").join(asked, [*scope, needle_id]) for c in (F.col("__n") <= FEW, F.col("__n") > FEW))
    held = docs.where(F.col(text).isNotNull()).select(*key, F.lower(text).alias("__text")).hint("merge")  # texts are not sent to all
    holds = lambda t: F.exists("__also", lambda o: F.contains(t, o))
    plain = F.array(F.replace("__text", F.lit(","), F.lit("")))  # bound once for all of the other texts
    hits = few.join(held, key).where(F.contains("__text", "__says")).select(
        *scope, needle_id, doc_id, F.coalesce(F.exists(plain, holds), F.lit(False)).alias("has_also")
    )
    if not counted.where(F.col("__n") > FEW).isEmpty():
        busy = sized(materialise(counted.where(F.col("__n") > FEW).select(*key).distinct(), "busy-texts"))
        own = docs.join(busy, key, "left_semi")
        hits = hits.unionByName(_by_automaton(many, needles, own, scope, needle_id, doc_id, text))
    hits = hits.groupBy(*key, needle_id).agg(F.bool_or("has_also").alias("has_also")).select(*scope, needle_id, doc_id, "has_also")
    return hits if also else hits.drop("has_also")


def _by_automaton(many: DataFrame, needles: DataFrame, docs: DataFrame, scope: list[str], needle_id: str, doc_id: str, text: str) -> DataFrame:
    """The rows of ``many`` (key, needle id, __says, __also) whose needle is in the text, with ``has_also``."""
    key = [*scope, doc_id]
    nothing = F.lit(None)
    wanted = many.select(*key, F.lit(1).alias("__kind"), F.col(needle_id).alias("__of"), "__says", "__also")
    held = docs.where(F.col(text).isNotNull()).select(
        *key, F.lit(0).alias("__kind"), nothing.cast(needles.schema[needle_id].dataType).alias("__of"), F.lower(text).alias("__says"),
        nothing.cast("array<string>").alias("__also"),
    )
    n = len(key)
    out_schema = StructType([*[docs.schema[c] for c in key], StructField("__of", needles.schema[needle_id].dataType), StructField("has_also", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, asked = None, [], []
        rows: list[tuple] = []

        def search() -> None:
            for at, others in _found(texts, asked):
                rows.append((*now, at, others))
            asked.clear()

        def done() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (n + 2)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        schema = None
        for b in batches:
            if schema is None:
                schema = pa.schema([*[b.schema.field(i) for i in range(n)], pa.field("__of", b.schema.field(n + 1).type), pa.field("has_also", pa.bool_())])
            parts = [b.column(i).to_pylist() for i in range(n + 4)]
            for own, kind, at, says, others in zip(zip(*parts[:n], strict=True), *parts[n:], strict=True):
                if own != now:
                    search()
                    now, texts = own, []
                if kind == 0:
                    texts.append(says)
                else:
                    asked.append((at, says, others))
                    if len(asked) >= MOST_NEEDLES:
                        search()
            yield done()
        search()
        if rows:
            yield done()

    both = held.union(wanted).repartition(*key).sortWithinPartitions(*key, "__kind")
    return both.mapInArrow(run, out_schema).withColumnRenamed("__of", needle_id).select(*scope, needle_id, doc_id, "has_also")


def _found(texts: list[str], asked: list[tuple[object, str, list[str] | None]]) -> Iterator[tuple[object, bool]]:
    """(id, whether one of its other texts occurs) of the needles that occur in one of the texts."""
    if not asked or not texts:
        return
    if len(asked) <= FEW:
        hit = [{i for i, (_, needle, _) in enumerate(asked) if needle in text} for text in texts]
    else:
        which: dict[str, list[int]] = {}
        for i, (_, needle, _) in enumerate(asked):
            which.setdefault(needle, []).append(i)
        everywhere = which.pop("", [])
        machine = ahocorasick.Automaton()
        for needle in which:
            machine.add_word(needle, needle)
        machine.make_automaton()
        hit = []
        for text in texts:
            seen = {needle for _, needle in machine.iter(text)} if which else set()
            hit.append({*everywhere, *(i for needle in seen for i in which[needle])})
    plain = [text.replace(",", "") if any(a[2] for a in asked) else "" for text in texts]
    for i in sorted(set().union(*hit)):
        at, _, others = asked[i]
        yield at, any(o in plain[t] for t, h in enumerate(hit) if i in h for o in others or () if o is not None)
