"""Personal data: fixed patterns, and a boosted-tree choice among high-recall candidates.

All work on texts is Spark expressions. The base patterns give spans that always stay. Generators
propose further, overlapping spans of looser formats; a sum of small boosted trees over features of
format and context, compiled to one expression, scores them, and a threshold calibrated per kind
selects. Features leave out the marks that the base patterns check (a plus sign, a check digit, the
signs of an address, written out or not). So a candidate that only lacks the mark looks like base
spans: it has one of their formats, and is no example of anything. Examples are base spans, and
against them the candidates of a format that no base span of the corpus has and that follow no cue.
The trees are fitted on the driver from a bounded sample of them, the thresholds on counts of
margins over all documents.

Patterns are written with possessive quantifiers and anchored at the beginning of a run of their
characters. That changes no match, and neither long runs nor long texts cost more than linear time
or any stack.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.store import written

KINDS = ("email", "ip", "card", "phone")
MAX_CANDIDATES = 20_000
PRECISION = 0.98
TREES = 30
RATE = 0.3
CHUNK = 64
LEAST = 20  # base spans of a kind without which nothing of it is added
BINS = 64  # of a unit of margin

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, by kind.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser formats: numbers in groups, and addresses with written-out signs.
NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++"
ADDRESS = (
    rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?+(?:@|\(at\)|\[at\])\x20?+[A-Za-z0-9-]++(?:\x20?+(?:\.|\(dot\)|\[dot\])\x20?+[A-Za-z0-9-]++)*+"
)
#: Words that stand before personal data.
CUES = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|iban|account|ip|address|ssn|kontakt|telefon|tarjeta|carte|adresse)\b[^A-Za-z0-9]*$"
BEFORE = 24
FEATURES = ("length", "digits", "spaces", "dashes", "dots", "parens", "groups", "longest", "letters", "cue", "left", "right", "over")


def found(text: Column, pattern: str, only: Column | None = None) -> tuple[Column, Column]:
    """All matches of a pattern, and the texts between them (null where nothing matches)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if only is not None:
        hits = F.when(only, hits).otherwise(F.array().cast("array<string>"))
    return hits, F.split(text, pattern, -1)


def with_places(rows: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """``rows`` (__hits, __gaps) with ``__spans``: start, end, text of each match that passes, in code points.

    Lengths are summed in chunks, in near-linear time. Each step is a column of its own and is used
    more than once, so that Spark computes it once a row and not once an element.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    hits, step, chunks, firsts = (F.col(c) for c in ("__hits", "__step", "__chunks", "__firsts"))
    each = F.zip_with(F.slice("__gaps", F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("int"))
    rows = rows.withColumn("__step", F.when(F.col("__gaps").isNotNull(), each))
    sums = F.transform(F.sequence(F.lit(0), F.size(step) - 1, F.lit(CHUNK)), lambda k: total(F.slice(step, k + 1, F.lit(CHUNK))))
    rows = rows.withColumn("__chunks", F.when(F.size(step) > 0, sums))
    rows = rows.withColumn("__firsts", F.when(F.size(chunks) > 0, F.transform(chunks, lambda x, k: total(F.slice(chunks, F.lit(1), k)))))

    def span(h: Column, i: Column) -> Column:
        k = F.floor(i / CHUNK).cast("int")
        end = F.element_at(firsts, k + 1) + total(F.slice(step, k * CHUNK + 1, i - k * CHUNK + 1))
        return F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("text"))

    spans = F.filter(F.transform(hits, span), lambda s: test(s["text"]))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return rows.withColumn("__spans", F.when((F.size(firsts) > 0) & (F.size(step) > 0), spans).otherwise(none)).drop("__step", "__chunks", "__firsts")


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Check digit of a string of at most 19 digits: every second one from the right counts twice."""
    padded = F.lpad(digits, 19, "0")
    out = F.lit(0)
    for i in range(19):
        d = F.substring(padded, i + 1, 1).cast("int")
        out = out + (d if i % 2 == 0 else (2 * d) % 10 + F.floor(d / 5).cast("int"))
    return out % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = F.split(s, r"\.")
        return F.forall(part, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255))
    n = F.length(digits_of(s))
    return n.between(16, 19) & luhn(digits_of(s)) if kind == "card" else n.between(8, 15)


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda x: valid(kind, x)


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def base_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with a column per kind: start and end of each base span."""
    t = F.col(text)
    only = {"email": F.contains(t, F.lit("@")), "phone": F.contains(t, F.lit("+"))}
    for kind, pattern in BASE.items():
        hits, gaps = found(t, pattern, only.get(kind))
        rows = rows.withColumn("__hits", hits)
        # matches and gaps once each; places only where something matches
        some = F.exists("__hits", _valid(kind))
        rows = rows.withColumn("__gaps", F.when(some, gaps))
        rows = with_places(rows, _valid(kind))
        rows = rows.withColumn(kind, F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return rows.drop("__hits", "__gaps", "__spans")


def _plausible(name: str) -> Callable[[Column], Column]:
    return (lambda h: F.length(digits_of(h)).between(7, 19)) if name == "number" else (lambda h: F.length(h) > 0)


def candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (with base spans) with ``__candidates``: kind, start, end, hit (overlaps a base span), own (one of its
    kind), format (what base spans of its look share) and features."""
    t = F.col(text)
    count = lambda s, what: F.length(s) - F.length(F.regexp_replace(s, what, ""))
    side = lambda c: F.when(c.rlike("^[A-Za-z]$"), 2).when(c.rlike("^[0-9]$"), 3).when(c.rlike(r"^\s?$"), 0).otherwise(1)
    written_at = F.contains(t, F.lit("@")) | F.contains(t, F.lit("(at)")) | F.contains(t, F.lit("[at]"))
    parts = []
    for name, pattern, only in (("address", ADDRESS, written_at), ("number", NUMBER, None)):
        hits, gaps = found(t, pattern, only)
        rows = rows.withColumn("__hits", hits)
        some = F.exists("__hits", _plausible(name))
        rows = rows.withColumn("__gaps", F.when(some, gaps))
        rows = with_places(rows, _plausible(name))
        address = name == "address"

        def described(s: Column) -> Column:
            h = s["text"]
            if address:  # signs that are written out count as such
                h = F.regexp_replace(F.regexp_replace(h, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
            n, dots = F.length(digits_of(h)), count(h, r"\.")
            quad = h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
            kind = F.lit("email") if address else F.when(quad, "ip").when(n >= 13, "card").otherwise("phone")
            base, own = F.lit(False), F.lit(False)
            for k in KINDS:
                overlaps = F.exists(F.col(k), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
                base, own = base | overlaps, own | (overlaps & (kind == k))
            runs = F.regexp_extract_all(h, F.lit("[0-9]+"), F.lit(0))
            before = F.substring(t, F.greatest(s["start"] + 1 - BEFORE, F.lit(1)), F.least(s["start"], F.lit(BEFORE)))
            features = {
                "length": F.length(h) - F.when(h.startswith("+"), 1).otherwise(0), "digits": n, "spaces": count(h, r"\x20"), "dashes": count(h, "-"), "dots": dots,
                "parens": count(h, "[()]"), "groups": F.size(runs), "longest": F.array_max(F.transform(runs, F.length)), "letters": count(h, "[A-Za-z]"),
                "cue": F.regexp_like(before, F.lit(CUES)).cast("int"), "left": side(F.right(before, F.lit(1))), "right": side(F.substring(t, s["end"] + 1, F.lit(1))),
                "over": F.exists(runs, lambda r: (F.length(r) > 3) | (r > F.lit("255")) & (F.length(r) == 3)).cast("int"),
            }
            shape = ["spaces", "dashes", "dots", "parens", "digits", "groups", "longest", "over"]
            look = [F.least(features["dots"], F.lit(1)), features["spaces"], features["parens"]] if address else [features[f] for f in shape]
            form = F.concat_ws(":", kind, *[F.coalesce(x, F.lit(0)).cast("string") for x in look])
            values = F.array(*[F.least(F.coalesce(features[f], F.lit(0)).cast("int"), F.lit(255)) for f in FEATURES])
            return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("hit"), own.alias("own"), form.alias("format"), values.alias("x"))

        kinds = "array<struct<kind:string,start:int,end:int,hit:boolean,own:boolean,format:string,x:array<int>>>"
        rows = rows.withColumn(f"__{name}", F.when(F.size("__spans") > 0, F.transform("__spans", described)).otherwise(F.array().cast(kinds)))
        parts.append(f"__{name}")
    return rows.withColumn("__candidates", F.concat(*parts)).drop("__hits", "__gaps", "__spans", *parts)


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut, (feature, cut, low, high) on either side); thresholds by kind."""

    start: float
    trees: list[tuple]
    thresholds: dict[str, float]

    def margin(self, x: Column) -> Column:
        at = lambda f: F.get(x, F.lit(f))
        leaf = lambda side: F.when(at(side[0]) <= side[1], side[2]).otherwise(side[3])
        out = F.lit(self.start)
        for f, cut, low, high in self.trees:
            out = out + F.when(at(f) <= cut, leaf(low)).otherwise(leaf(high))
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        leaf = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
        out = np.full(len(x), self.start)
        for f, cut, low, high in self.trees:
            out += np.where(x[:, f] <= cut, leaf(low), leaf(high))
        return out


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, float, float]:
    """The best cut of a set by gain: gain, feature, cut, and the steps of both sides. Features are small whole numbers."""
    best = (-1.0, 0, 0, 0.0, 0.0)
    total_g, total_h = g.sum(), h.sum()
    for f in range(x.shape[1]):
        values = np.bincount(x[:, f], minlength=2)
        lg, lh = np.cumsum(np.bincount(x[:, f], g, 2)), np.cumsum(np.bincount(x[:, f], h, 2))
        gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1)
        gain[(values == 0) | (np.cumsum(values) == len(x))] = -1.0
        cut = int(gain.argmax())
        if gain[cut] > best[0] + 1e-12:
            best = (float(gain[cut]), f, cut, RATE * lg[cut] / (lh[cut] + 1), RATE * (total_g - lg[cut]) / (total_h - lh[cut] + 1))
    if best[0] < 0:
        step = RATE * total_g / (total_h + 1)
        return 0.0, 0, 0, step, step
    return best


def boost(x: np.ndarray, y: np.ndarray, kinds: Sequence[str], weights: np.ndarray, apart: np.ndarray, trees: int = TREES, precision: float = PRECISION) -> Trees:
    """Fit on the rows that are not ``apart``; on those that are, each kind's threshold is the lowest margin whose precision suffices.

    A kind for which none does, or a sample without both labels, gets no threshold: nothing is added.
    """
    model = Trees(0.0, [], {})
    x = np.clip(x, 0, 255)
    fx, fy, fw = x[~apart], y[~apart].astype(float), weights[~apart]
    if not len(fy) or fy.min() == fy.max():
        return model
    mean = float((fy * fw).sum() / fw.sum())
    model.start = float(np.log(mean / (1 - mean)))
    at = np.full(len(fy), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at))
        g, h = fw * (fy - p), fw * p * (1 - p)
        _, f, cut, _, _ = _split(fx, g, h)
        low = fx[:, f] <= cut
        sides = tuple(_split(fx[s], g[s], h[s])[1:] for s in (low, ~low))
        model.trees.append((f, cut, *sides))
        one = Trees(0.0, model.trees[-1:], {})
        at = at + one.margins(fx)
    margins = model.margins(x[apart])
    for kind in set(kinds):
        own = np.array([k == kind for k in kinds])[apart]
        m, t, w = margins[own], y[apart][own].astype(float), weights[apart][own]
        order = np.argsort(-m, kind="stable")
        right = np.cumsum((t * w)[order]) / np.cumsum(w[order])
        last = np.append(m[order][1:] != m[order][:-1], True) if len(order) else np.zeros(0, bool)
        good = np.flatnonzero((right >= precision) & last)
        if len(good) and (t * w).sum() >= LEAST:
            model.thresholds[kind] = float(m[order][good[-1]])
    return model


def examples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """apart, kind, x, y of the candidates of all texts that tell something: y is true for base spans, and false for
    candidates of a format that no base span has and that follow no cue."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # a table: Spark would otherwise push the fields wanted into the expressions, again and again
    apart = (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("apart")
    each = written(candidates(base_spans(rows)).select(apart, "__candidates"), "candidates")
    each = each.select("apart", F.explode("__candidates").alias("c")).select("apart", "c.*")
    known = each.where("own").select("format", F.lit(True).alias("known")).distinct()
    each = each.join(known, "format", "left")
    cue = F.get("x", F.lit(FEATURES.index("cue")))
    y = F.when(F.col("own"), True).when(~F.col("hit") & F.col("known").isNull() & (cue == 0), False)
    return written(each.select("apart", "kind", "x", y.alias("y")).where("y is not null"), "examples")


def calibrated(told: DataFrame, model: Trees, precision: float = PRECISION) -> dict[str, float]:
    """By kind, the margin from which up base spans are at least ``precision`` of the examples.

    It lies halfway between the lowest base span that may be selected and the next example below it;
    where none is below, at even odds or at that base span, whichever is lower. Counts of margins over
    all examples that are ``apart``. No threshold where there are fewer than ``LEAST`` base spans, or
    none may be selected: nothing of that kind is added.
    """
    bins = told.where("apart").groupBy("kind", F.floor(model.margin(F.col("x")) * BINS).alias("bin")).agg(
        F.count_if("y").alias("right"), F.count_if(~F.col("y")).alias("wrong")
    ).collect()
    out: dict[str, float] = {}
    for kind in KINDS:
        own = sorted((r for r in bins if r.kind == kind), key=lambda r: -r.bin)
        right = wrong = 0
        for r, below in zip(own, [*own[1:], None], strict=False):
            right, wrong = right + r.right, wrong + r.wrong
            if r.right and right >= precision * (right + wrong):
                out[kind] = (r.bin + below.bin + 1) / 2 / BINS if below else min(r.bin / BINS, 0.0)
        if right < LEAST:
            out.pop(kind, None)
    return out


def fit(docs: DataFrame, *, text_col: str = "text", max_candidates: int = MAX_CANDIDATES) -> Trees:
    """Trees from at most ``max_candidates`` different examples, chosen by hash; thresholds from all examples."""
    told = examples(docs, text_col)
    keys = ["apart", "kind", "x", "y"]
    got = told.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.xxhash64(*keys), *keys).limit(max_candidates).collect()
    if not got:
        return Trees(0.0, [], {})
    weights = np.array([r.n for r in got], float)
    model = boost(np.array([list(r.x) for r in got]), np.array([r.y for r in got]), [r.kind for r in got], weights, np.array([r.apart for r in got]))
    model.thresholds = calibrated(told, model) if model.trees else {}
    return model


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None, redact: bool = True) -> DataFrame:
    """id, base and spans (arrays of kind, start, end in code points, end exclusive) and, with ``redact``, redacted.

    Spans are ordered by kind (email, ip, card, phone), then start. ``spans`` holds all base spans and
    the selected candidates that overlap none of them nor each other (of overlapping ones the better).
    ``redacted`` replaces each span, overlapping ones as one, by `[kind]`. Null and empty texts have no
    spans. Each row stands for itself: ids may be null or repeated. An empty table gives an empty result.
    """
    model = fit(docs, text_col=text_col) if model is None else model
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = base_spans(rows)
    named = [F.transform(F.col(k), _named(k)) for k in KINDS]
    if not model.thresholds:
        rows = rows.withColumn("base", F.concat(*named)).withColumn("spans", F.col("base"))
    else:
        rows = candidates(rows)
        cut = lambda c: F.coalesce(*[F.when(c["kind"] == k, F.lit(v)) for k, v in sorted(model.thresholds.items())], F.lit(float("inf")))
        scored = F.transform(
            F.filter("__candidates", lambda c: ~c["hit"]),
            lambda c: F.struct((-model.margin(c["x"])).alias("m"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), cut(c).alias("cut")),
        )
        chosen = F.array_sort(F.filter(scored, lambda c: -c["m"] >= c["cut"]))
        rows = rows.withColumn("__chosen", F.when(F.exists("__candidates", lambda c: ~c["hit"]), chosen).otherwise(F.array().cast("array<struct<m:double,start:int,end:int,kind:string,cut:double>>")))
        # the best first; one that overlaps a better one goes
        better = lambda c, i: F.exists(F.slice("__chosen", F.lit(1), i), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        extra = F.filter("__chosen", lambda c, i: ~better(c, i))
        rows = rows.withColumn("__extra", extra)
        of_kind = lambda k: F.transform(F.filter("__extra", lambda c: c["kind"] == k), _named(k))
        by_kind = [F.array_sort(F.concat(own, of_kind(k))) for k, own in zip(KINDS, named, strict=True)]
        rows = rows.withColumn("base", F.concat(*named)).withColumn("spans", F.concat(*by_kind))
    if not redact:
        return rows.select("id", "base", "spans")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(a: Column, s: Column) -> Column:
        end = -s["end"]
        plain = F.when(s["start"] >= a["at"], F.concat(F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(a["out"], plain).alias("out"), F.greatest(a["at"], end).alias("at"))

    text = F.aggregate(ordered, state, put, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    return rows.select("id", "base", "spans", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("redacted"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
