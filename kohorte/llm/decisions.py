"""Quality rules: a learned decision list over text statistics, in DataFrame expressions only.

Statistics of a text are column expressions, so applying a list is one narrow projection. The list is learned by
sequential covering from labelled statistics. A rule is grown condition by condition (the best FOIL gain over
thresholds that are quantiles of the sample), then cut back to the prefix that does best on the third of the sample
that it wasn't grown on. What it covers is taken away and the next rule is learned. One grouped count over the sample
gives the numbers for all candidate conditions at once.

Learning uses at most ``MAX_LABELLED`` labelled documents, those with the smallest hashes of their ids. Null and
empty texts have no words. Without labels the list is empty and keeps all that passes the base rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorte.llm.scratch import Scratch

MAX_LABELLED = 20_000
QUANTILES = 24
MAX_RULES, MAX_CONDITIONS = 12, 4
LEAST_COVERED, LEAST_PRECISION = 15, 0.8

BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?.,;:"

FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "capitals_share": "n_capitals / word_chars",
    "repeated_lines_share": "n_dup_lines / n_lines",
    "repeated_words_share": "n_repeat_words / n_words",
    "words_per_line": "n_words / n_lines",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return F.coalesce(value > self.threshold if self.above else value <= self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejected: int       # of the sample, among those that earlier rules leave
    accepted: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _once(value: Column) -> Column:
    """``value``, not copied into filters and projections above, where a lambda would compute it for every element:
    the optimizer leaves expressions with a row number where they are."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the statistics of its texts instead of the texts."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    kept = [c for c in docs.columns if c != text_column]
    words = F.array_remove(F.split(text, BLANKS, -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)
    cut = docs.select(
        *kept, _once(words).alias("__words"), _once(lines).alias("__lines"), F.length(F.translate(text, BLANK_CHARS, "")).alias("word_chars"),
        _without(text, SYMBOLS).alias("n_symbols"), _without(text, CAPITALS).alias("n_capitals"), _without(text, MARKS).alias("n_marks"))
    n = F.size("__words")
    counted = cut.select(
        *kept, n.alias("n_words"), "word_chars", "n_symbols", "n_capitals", "n_marks", F.size("__lines").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _once(F.when(n >= 3, F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)).alias("g"), i.alias("p"))))))
        .alias("__grams"))
    # Positions of three-word windows whose sorted neighbour is the same window.
    same = lambda i, j: F.coalesce(F.get("__grams", i)["g"] == F.get("__grams", j)["g"], F.lit(False))
    placed = counted.withColumn("__at", F.when(F.size("__grams") > 1, F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("__grams") - 1), lambda i: same(i, i - 1) | same(i, i + 1)),
        lambda i: F.get("__grams", i)["p"]))))
    repeated = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                           lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
                           lambda a: a["n"])
    longs = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_lines", "n_dup_lines"]
    return placed.select(*kept, *[F.col(c).cast("long").alias(c) for c in longs],
                         F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """Documents with their label (the smallest, where there are several), at most ``most``."""
    picked = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(id_column).agg(F.min(label).alias("__label")) \
        .orderBy(F.xxhash64(id_column), id_column).limit(most)
    return docs.join(F.broadcast(picked), id_column)    # at most ``most`` rows of two numbers


def learn(sample: DataFrame, *, label: str = "__label") -> list[Rule]:
    """A decision list from statistics and a label (0: to reject)."""
    spark = sample.sparkSession
    scratch = Scratch(spark, "decisions")
    values = sample.select(F.col("doc_id"), (F.col(label) == 0).alias("bad"),
                           *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()])
    values = scratch.keep(values, "values")
    steps = [(i + 1) / (QUANTILES + 1) for i in range(QUANTILES)]
    row = values.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({round(x, 6) for x in row[f] or [] if x is not None}) for f in FEATURES}
    # Of each row the number of cuts below its value, feature by feature; a condition is a bound on that number.
    names = list(FEATURES)
    below = [F.coalesce(sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)), F.lit(0)) for f in names]
    binned = scratch.keep(values.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("held"),
                                        F.array(*below).alias("bins")), "binned")

    def meets(condition: tuple[int, bool, int]) -> Column:
        feature, above, cut = condition
        return F.get("bins", F.lit(feature)) > cut if above else F.get("bins", F.lit(feature)) <= cut

    def counts(conditions: list) -> dict:
        rows = left
        for c in conditions:
            rows = rows.where(meets(c))
        out = rows.select("bad", "held", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin", "bad", "held").count()
        return {(r["feature"], r["bin"], r["bad"], r["held"]): r["count"] for r in out.collect()}     # features x cuts x 4

    rules, left = [], binned
    least = min(LEAST_COVERED, max(3, binned.count() // 60))      # fewer in small samples
    while len(rules) < MAX_RULES:
        grown: list[tuple[int, bool, int]] = []
        history = []
        table = counts([])
        while True:
            total = {(b, h): sum(v for (f, _, bb, hh), v in table.items() if f == 0 and (bb, hh) == (b, h))
                     for b in (True, False) for h in (True, False)}
            history.append(total)
            p0, n0 = total[True, False], total[False, False]
            if len(grown) == MAX_CONDITIONS or not n0 or p0 < least:
                break
            best = None
            for f, name in enumerate(names):
                for cut in range(len(cuts[name])):
                    for above in (True, False):
                        p, n = (sum(table.get((f, x, bad, False), 0) for x in (range(cut + 1, len(cuts[name]) + 1) if above else range(cut + 1)))
                                for bad in (True, False))
                        if p < least or p + n == p0 + n0:
                            continue
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, (f, above, cut))
            if best is None or best[0] <= 0:
                break
            grown.append(best[1])
            table = counts(grown)
        # Prune: the prefix with the best (p - n) / (p + n) on the rows that the rule wasn't grown on.
        def worth(total: dict) -> float:
            p, n = total[True, True], total[False, True]
            return (p - n) / (p + n) if p + n else -1.0
        prefixes = [(round(worth(history[k]), 6), -k) for k in range(1, len(grown) + 1)]
        if not prefixes:
            break
        k = -max(prefixes)[1]
        p, n = (history[k][bad, True] + history[k][bad, False] for bad in (True, False))
        if (worth(history[k]) + 1) / 2 < LEAST_PRECISION or p < least:
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[names[f]][cut]) for f, above, cut in grown[:k]), p, n))
        covered = F.lit(True)
        for c in grown[:k]:
            covered = covered & meets(c)
        left = left.where(~covered)
    scratch.drop()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null where none does."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(str(rule))) if out is None else out.when(rule.column(), F.lit(str(rule)))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, labels: DataFrame, *, label: str = "quality") -> DataFrame:
    """doc_id, the statistics, base_failed, the rule that rejects (or null) and kept, of every document."""
    rows = docs.select("doc_id", "text")
    sample = labelled_sample(rows, labels, "doc_id", label)
    rules = learn(statistics(sample).where(~base_failed()))
    own = statistics(rows).withColumn("base_failed", base_failed())
    return own.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules))) \
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
