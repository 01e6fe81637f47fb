"""Learned decision lists over text statistics, with DataFrame operations only.

``statistics`` computes the columns of every whole text inside its row, without a shuffle. ``learn`` runs sequential
covering on labelled statistics: a rule grows by the threshold that gains most (FOIL) on two thirds of the examples, loses
its last conditions where that helps on the other third, and is accepted while its precision there holds; what it covers is
set aside and the next rule is learned. Every step is one small aggregation by (statistic, bin); only those counts reach
the driver. ``verdict`` turns the ordered rules into one Spark conditional expression.

The examples are at most ``sample`` labelled rows, those with the smallest hash of their id.

Defined results: a null or empty text has 0 in every statistic and fails the base rule; without labels, or with labels of
one class only, no rule is learned and the base rule alone decides; rows are judged one by one, extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import staged, text_of

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]+"
RATIOS = ("mean_word", "symbol_share", "dup_share", "repeat_share", "capital_share", "mark_share", "digit_share", "length")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also if ``use`` refers to it within lambdas."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""

    def of_windows(marks: Column) -> Column:
        def of_sorted(pairs: Column) -> Column:
            hit = lambda x, k: (F.get(pairs, k - 1)["mark"] == x["mark"]) | (F.get(pairs, k + 1)["mark"] == x["mark"])
            at = F.filter(pairs, lambda x, k: F.coalesce(hit(x, k), F.lit(False)))
            spread = F.transform(at, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
            return F.size(F.array_distinct(F.flatten(spread)))

        pairs = F.sort_array(F.transform(marks, lambda m, k: F.struct(m.alias("mark"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), F.lit(0)).otherwise(bound(pairs, of_sorted))

    triple = lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2))
    marks = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), triple)
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bound(marks, of_windows))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""
    text = F.col("text")
    core = F.btrim(text, F.lit(BLANKS))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, GAP))
    base = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", words.alias("words"))
    without = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_BLANK))
    counts = base.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        without(SYMBOLS).cast("bigint").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("line"),
        repeated_words(F.col("words")).cast("bigint").alias("n_repeat_words"),
        without("[A-Z]+").alias("capitals"),
        without("[!?]+").alias("marks"),
        without("[0-9]+").alias("digits"),
    )
    per = lambda value, whole: F.coalesce(F.try_divide(value.cast("double"), whole), F.lit(0.0))
    c = F.col
    return counts.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        c("line.dup").cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        per(c("word_chars"), c("n_words")).alias("mean_word"),
        per(c("n_symbols"), c("n_words")).alias("symbol_share"),
        per(c("line.dup"), c("line.lines")).alias("dup_share"),
        per(c("n_repeat_words"), c("n_words")).alias("repeat_share"),
        per(c("capitals"), c("word_chars")).alias("capital_share"),
        per(c("marks"), c("n_words")).alias("mark_share"),
        per(c("digits"), c("word_chars")).alias("digit_share"),
        c("n_words").cast("double").alias("length"),
    )


@dataclass(frozen=True)
class Condition:
    name: str
    threshold: float
    above: bool

    def column(self) -> Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


def conjunction(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def verdict(rules: list[list[Condition]], default: bool = True) -> Column:
    """The ordered rules as one expression: the first that fits rejects, else the default holds."""
    out = None
    for rule in rules:
        out = (F.when if out is None else out.when)(conjunction(rule), F.lit(not default))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _bins(examples: DataFrame, names: tuple[str, ...], bins: int) -> dict[str, list[float]]:
    at = [k / bins for k in range(1, bins)]
    row = examples.agg(*(F.percentile_approx(n, at, 10_000).alias(n) for n in names)).first()
    return {n: sorted(set(row[n] or [])) for n in names}


def _grown(left: DataFrame, thresholds: dict[str, list[float]], most: int) -> list[Condition]:
    """Conditions added one by one while they gain."""
    rule: list[Condition] = []
    names = list(thresholds)
    while len(rule) < most and any(thresholds.values()):
        places = F.array(*(
            F.struct(F.lit(k).alias("name"), sum((F.col(n) > t).cast("int") for t in thresholds[n]).alias("bin"))
            for k, n in enumerate(names) if thresholds[n]
        ))
        counts = (
            left.where(conjunction(rule)).select("bad", F.explode(places).alias("x"))
            .groupBy("x.name", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        )
        by = {(r["name"], r["bin"]): (r["p"], r["n"]) for r in counts}
        best, top = None, 1e-9
        for k, n in enumerate(names):
            column = [by.get((k, b), (0, 0)) for b in range(len(thresholds[n]) + 1)]
            p0, n0 = sum(p for p, _ in column), sum(x for _, x in column)
            if not p0 or not n0:
                continue
            low_p = low_n = 0
            for t, (p, x) in zip(thresholds[n], column):
                low_p, low_n = low_p + p, low_n + x
                for above, q, y in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    gain = _gain(q, y, p0, n0)
                    if gain > top:
                        best, top = Condition(n, t, above), gain
        if best is None:
            break
        rule.append(best)
    return rule


def _pruned(held: DataFrame, rule: list[Condition]) -> tuple[list[Condition], int, int]:
    """The best beginning of a rule on held-out examples, with what it covers of either class."""
    sums = []
    for k in range(1, len(rule) + 1):
        inside = conjunction(rule[:k]).cast("int")
        sums += [F.sum(inside * F.col("bad")), F.sum(inside * (1 - F.col("bad")))]
    row = [x or 0 for x in held.agg(*sums).first()]
    worth = lambda k: (row[2 * k] - row[2 * k + 1]) / max(1, row[2 * k] + row[2 * k + 1])
    best = max(range(len(rule)), key=lambda k: (worth(k), row[2 * k], -k))
    return rule[: best + 1], row[2 * best], row[2 * best + 1]


def learn(
    spark: SparkSession,
    stats: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    bins: int = 24,
    most_rules: int = 8,
    most_conditions: int = 3,
    precision: float = 0.95,
    least: int = 5,
) -> list[list[Condition]]:
    """Ordered rules for low quality, from at most ``sample`` labelled rows."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    one = stats.groupBy("doc_id").agg(*(F.first(n).alias(n) for n in RATIOS))
    examples = staged(
        spark,
        one.join(chosen, "doc_id")
        .select((1 - F.col("quality")).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0).alias("held"), *RATIOS),
        "examples",
    )
    thresholds = _bins(examples, RATIOS, bins)
    left, held = examples.where(~F.col("held")), examples.where("held")
    rules: list[list[Condition]] = []
    while len(rules) < most_rules:
        grown = _grown(left, thresholds, most_conditions)
        if not grown:
            break
        rule, p, n = _pruned(held, grown)
        if p < least or p < precision * (p + n):
            break
        rules.append(rule)
        left, held = left.where(~conjunction(rule)), held.where(~conjunction(rule))
    return rules


def judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """doc_id, the statistics of the base rule, base_failed, kept of every row."""
    stats = staged(spark, statistics(docs), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = learn(spark, stats.where(~failed), labels, **learning)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & verdict(rules)).alias("kept"),
    )
