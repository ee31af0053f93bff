"""Bulk answer grading: answer table in, verdict and reason columns (or an audit) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions import answers as A

VERDICT = r"(?i)(VERDICT_CORRECT|VERDICT_INCORRECT)"


def extract_numbers(df: DataFrame, text: str = "answer") -> DataFrame:
    """Add parsed number, K/M suffix and the number with the suffix applied."""
    found = F.col("__found")
    return df.withColumn("__found", A.number_text(F.col(text))).select(
        *df.columns,
        A.number_value(found).alias("number"),
        A.number_suffix(found).alias("suffix"),
        (A.number_value(found) * A.suffix_factor(found)).alias("scaled"),
    )


def number_audit(df: DataFrame, by: list[str], text: str = "answer") -> DataFrame:
    """Per group: rows, rows without a number, rows with a suffix, smallest and largest number."""
    return extract_numbers(df, text).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("number").isNull()).alias("n_unparsable"),
        F.count_if(F.col("suffix") != "").alias("n_suffix"),
        F.min("scaled").alias("min_number"),
        F.max("scaled").alias("max_number"),
    )


def grade_with(df: DataFrame, rule: Column, out: str = "correct") -> DataFrame:
    return df.withColumn(out, rule)


def grade_numeric(df: DataFrame, answer: str = "answer", truth: str = "truth") -> DataFrame:
    return grade_with(df, A.numeric_match(A.strip(answer), F.col(truth)))


def grade_entity(df: DataFrame, answer: str = "answer", truth: str = "truth") -> DataFrame:
    return grade_with(df, A.entity_match(A.strip(answer), A.strip(truth)))


def grade_name_value(df: DataFrame, answer: str = "answer", truth: str = "truth") -> DataFrame:
    return grade_with(df, A.name_value_match(A.strip(answer), A.strip(truth)))


def grade_abstention(df: DataFrame, answer: str = "answer") -> DataFrame:
    return grade_with(df, A.abstention_match(A.strip(answer)))


def grade_answers(df: DataFrame) -> DataFrame:
    """Add ``correct`` and ``reason`` to rows of (answer, truth, competency).

    Exact match ignoring case, else the rule of the competency. Every competency asks for a name, a number
    or both, so the rules share one name check and one number check. Their inputs are columns of their
    own: each regular expression runs at most once per row, and only where its result is needed.
    """
    comp = F.col("competency")
    abstention = comp == "abstention"
    said, goal, open_row = F.col("__said"), F.col("__goal"), F.col("__open")
    pair = F.col("__pair")
    d = df.withColumn("__said", A.strip(F.coalesce("answer", F.lit("")))).withColumn("__goal", A.strip("truth"))
    exact = F.coalesce(F.lower(said) == F.lower(goal), F.lit(False))
    d = d.withColumn("__exact", exact).withColumn("__open", ~F.col("__exact") & (said != "") & ~abstention)
    d = d.withColumn("__pair", F.coalesce(open_row & comp.isin(A.NAME_VALUE_TYPES) & goal.rlike(A.NAME_VALUE), F.lit(False)))
    d = d.withColumns({
        "__name": F.when(pair, A.strip(F.regexp_extract(goal, A.NAME_VALUE, 1)))
        .when(open_row & comp.isin(A.NAME_VALUE_TYPES + A.ENTITY_TYPES), goal),
        "__value": F.when(pair, A.strip(F.regexp_extract(goal, A.NAME_VALUE, 2)))
        .when(open_row & comp.isin(A.NUMERIC_TYPES), F.col("truth")),
    })
    name, value = F.col("__name"), F.col("__value")
    d = d.withColumns({
        "__found": F.when(value.isNotNull(), A.number_text(said)),
        "__want": F.when(value.isNotNull(), A.number_goal(value)),
        "__n1": F.when(name.isNotNull(), A.bare_name(said)),
        "__n2": F.when(name.isNotNull(), A.bare_name(name)),
    })
    d = d.withColumns({
        "__plain": A.number_value(F.col("__found")),
        "__t1": A.name_tokens(F.col("__n1")),
        "__t2": A.name_tokens(F.col("__n2")),
    })
    plain = F.col("__plain")
    number_ok = A.numbers_agree(plain, plain * A.suffix_factor(F.col("__found")), F.col("__want"), value)
    name_ok = A.names_agree(F.col("__n1"), F.col("__n2"), F.col("__t1"), F.col("__t2"))
    ruled = (
        F.when(F.col("__exact"), True)
        .when(abstention, A.abstention_match(said))
        .when(name.isNotNull() & value.isNotNull(), name_ok & number_ok)
        .when(name.isNotNull(), name_ok)
        .when(value.isNotNull(), number_ok)
        .when(comp == "temporal_trend", F.contains(F.lower(said), F.lower(goal)))
        .otherwise(False)
    )
    empty = said == ""
    d = d.withColumn("correct", F.when(empty & ~abstention, F.lit(False)).otherwise(F.coalesce(ruled, F.lit(False))))
    reason = (
        F.when(abstention, "rule:abstention").when(empty, "rule:empty_answer").when(F.col("correct"), "rule:pass").otherwise("rule:fail")
    )
    return d.select(*df.columns, "correct", reason.alias("reason"))


def grading_audit(graded: DataFrame, by: list[str]) -> DataFrame:
    """Verdict counts per group and reason."""
    return graded.groupBy(*by, "reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct").cast("bigint")).alias("n_correct"),
    )


def parse_verdict(reply: Column) -> Column:
    """Last verdict token of a judge's reply; null if there is none."""
    hits = F.regexp_extract_all(reply, F.lit(VERDICT), F.lit(1))
    return F.upper(F.try_element_at(hits, F.lit(-1))) == "VERDICT_CORRECT"


def apply_judge_verdicts(graded: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Let logged judge replies decide rule failures. No reply or no verdict fails closed.

    ``replies`` has the keys (one row each) and ``reply``.
    """
    judged = graded.join(replies.select(*keys, "reply"), keys, "left")
    verdict = parse_verdict(F.col("reply"))
    open_row = F.col("reason") == "rule:fail"
    return (
        judged.withColumn("__v", F.when(open_row, verdict))
        .withColumn("correct", F.when(open_row, F.coalesce("__v", F.lit(False))).otherwise(F.col("correct")))
        .withColumn(
            "reason",
            F.when(open_row & F.col("reply").isNull(), "judge:no_reply")
            .when(open_row & F.col("__v").isNull(), "judge:no_verdict")
            .when(open_row & F.col("__v"), "judge:correct")
            .when(open_row, "judge:incorrect")
            .otherwise(F.col("reason")),
        )
        .drop("__v", "reply")
    )


def single_turn_score(df: DataFrame, reward: str = "reward", answer: str = "answer", truth: str = "truth") -> DataFrame:
    """Logged reward if present, else 1 for an exact or 2 % numeric match, else 0."""
    said, goal = F.lower(A.strip(answer)), F.lower(A.strip(truth))
    num = lambda c: F.translate(c, ",%", "").try_cast("double")
    a, t = num(said), num(goal)
    close = F.when(t == 0, a == 0).otherwise(F.abs(a - t) / F.abs(t) <= A.FLOAT_TOLERANCE)
    missing = F.coalesce((F.col(answer) == "") | (F.col(truth) == ""), F.lit(True))
    return df.withColumn(
        "score",
        F.coalesce(
            F.col(reward).cast("double"),
            F.when(missing, 0.0).when(said == goal, 1.0).when(F.coalesce(close, F.lit(False)), 1.0).otherwise(0.0),
        ),
    )


def judge_pending(graded: DataFrame, judge) -> DataFrame:
    """Send only the rule failures through a user-supplied judge and merge its verdicts.

    ``judge`` is a vectorised UDF column function (question, truth, answer, competency) returning
    struct<correct: boolean, reason: string>; a null struct fails closed.
    """
    # a condition on an exploded column stays above the grading: pushed below, it would repeat every rule in itself
    split = graded.select("*", F.explode_outer(F.array(F.col("reason") == "rule:fail")).alias("__open"))
    pending = split.where("__open").drop("__open")
    done = split.where("not __open").drop("__open")
    judged = pending.withColumn("__j", judge("question", "truth", "answer", "competency"))
    judged = (
        judged.withColumn("correct", F.coalesce(F.col("__j.correct"), F.lit(False)))
        .withColumn("reason", F.concat(F.lit("judge:"), F.coalesce(F.col("__j.reason"), F.lit("failed"))))
        .drop("__j")
    )
    return done.unionByName(judged)
