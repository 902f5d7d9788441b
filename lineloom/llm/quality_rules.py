"""Quality rules as a learned decision list, in DataFrame functions alone.

Each text's statistics are built-in expressions. The labelled rows' statistics are cut at quantiles and counted
by cell and class in one aggregation; the number of cells is bounded by CUTS and the number of features,
whatever the corpus. Sequential covering on these counts grows a conjunction of thresholds by information gain,
prunes it on rows kept apart, and removes what it covers, until no rule holds up. Rules are for bad texts; where none holds up, one
for good texts is grown, whose rows go, so that the next rule for bad texts may hold up among the rest: the order counts. The list becomes one
conditional expression that Spark compiles.

Defined results: null or empty text has no words and fails the base rule. Rows are judged one by one; repeated rows
get equal results. Of several labels of a doc_id the smallest quality counts; a null label or doc_id isn't learned
from. Ties go to the condition first in order of features and cuts. Without labels of both classes, as in an empty table, the list is empty and the base
rule decides. Other columns of either table are ignored. A very long text is counted as a whole; its windows are held in one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.storage import materialize

#: Quantiles of each feature at which conditions may cut.
CUTS = (0.02, 0.1, 0.5, 0.9, 0.98)
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "capitals", "bars")
MAX_RULES, MAX_CONDITIONS = 12, 3
#: A rule for bad texts, or one for good texts, must be right on such a share both of the rows grown on and of those kept apart, and cover so many rows in all.
MIN_PRECISION, MIN_COVER = (0.9, 0.98), 10
MIN_WORDS = 50

_SPACE = " \t\n\x0b\f\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text that isn't null."""
    trimmed = F.regexp_replace(text, r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def repeat_words(words: Column, n: Column) -> Column:
    """Words within 3-word windows that the text has twice or more, each counted once.

    Windows are sorted by hash, equal ones side by side; neighbours of one hash are held against each other word by word.
    """

    def windows() -> Column:
        one = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), one))

    def same(x: Column, y: Column) -> Column:
        word = lambda k: F.get(words, x["at"] + k) == F.get(words, y["at"] + k)
        return F.coalesce((x["h"] == y["h"]) & word(0) & word(1) & word(2), F.lit(False))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))
        at = F.sort_array(F.transform(twice, lambda x: x["at"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(windows(), covered))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    only = lambda chars: F.length(F.regexp_replace("text", f"[^{chars}]+", "")).cast("long")
    worded = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    of_words = let(word_array(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w, F.size(w)).alias("n_repeat_words")))
    of_lines = let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    s = t.select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.regexp_replace("text", r"[ \t-\r]+", "")).cast("long").alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"),
        only("A-Z").alias("n_capitals"),
        only("|").alias("n_bars"),
    )
    return s.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_capitals", "n_bars")


def features() -> dict[str, Column]:
    """Of each feature, its expression over the statistics."""
    a_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word": a_word("word_chars"),
        "symbols": a_word("n_symbols"),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": a_word("n_repeat_words"),
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bars": a_word("n_bars"),
    }


@dataclass(frozen=True)
class Condition:
    """above: the feature exceeds the threshold; else it doesn't. cut: the threshold's place among the feature's cuts."""

    feature: str
    cut: int
    above: bool
    threshold: float

    def holds(self, cell: tuple[int, ...], place: int) -> bool:
        return (cell[place] > self.cut) == self.above

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class Rule:
    """keep: what the list says of a text for which all conditions hold, and no earlier rule does."""

    conditions: tuple[Condition, ...]
    keep: bool

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


#: A cell's counts: bad and good rows to grow on, bad and good rows to prune on.
Cells = dict[tuple[int, ...], tuple[int, int, int, int]]


def learn(cells: Cells, cuts: dict[str, list[float]]) -> list[Rule]:
    """The decision list: rules in order; what none of them decides is kept."""
    names = list(cuts)
    place = {f: i for i, f in enumerate(names)}
    every = [Condition(f, k, above, t) for f in names for k, t in enumerate(cuts[f]) for above in (True, False)]
    rules: list[Rule] = []
    left = dict(cells)

    def covers(conditions, cell) -> bool:
        return all(c.holds(cell, place[c.feature]) for c in conditions)

    def count(conditions, keep: bool, apart: bool) -> tuple[int, int]:
        """Covered rows of the rule's class, and of the other."""
        hit = [n for cell, n in left.items() if covers(conditions, cell)]
        own, other = (2 * apart + keep, 2 * apart + (not keep))
        return sum(n[own] for n in hit), sum(n[other] for n in hit)

    def worth(own: int, other: int) -> float:
        return (own - other) / (own + other) if own + other else -1.0

    def grown(keep: bool) -> Rule | None:
        rule: list[Condition] = []
        own, other = count(rule, keep, False)
        while own and other and len(rule) < MAX_CONDITIONS:
            best, best_gain, best_n = None, 1e-9, (0, 0)
            for c in every:
                if c in rule:
                    continue
                x, y = count([*rule, c], keep, False)
                if x and (gain := x * (math.log2(x / (x + y)) - math.log2(own / (own + other)))) > best_gain:
                    best, best_gain, best_n = c, gain, (x, y)
            if best is None:
                break
            rule.append(best)
            own, other = best_n
        while len(rule) > 1 and worth(*count(rule[:-1], keep, True)) >= worth(*count(rule, keep, True)):
            rule.pop()
        (x, y), (gx, gy) = count(rule, keep, True), count(rule, keep, False)
        least = MIN_PRECISION[keep]
        if not rule or x + gx < MIN_COVER or x < least * (x + y) or gx < least * (gx + gy):
            return None
        return Rule(tuple(rule), keep)

    while len(rules) < MAX_RULES and (rule := grown(False) or grown(True)):
        rules.append(rule)
        left = {cell: n for cell, n in left.items() if not covers(rule.conditions, cell)}
    while rules and rules[-1].keep:  # says what is said of the rest anyway
        rules.pop()
    return rules


def labelled_cells(stats: DataFrame, labels: DataFrame) -> tuple[Cells, dict[str, list[float]]]:
    """Counts by cell and class of the labelled rows, and the cuts. At most (len(CUTS) + 1) ** len(FEATURES) cells are collected."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    x = stats.filter(F.col("n_words") >= MIN_WORDS).join(known, "doc_id").select("doc_id", "quality", *(c.alias(f) for f, c in features().items()))
    x = materialize(x, "quality-labelled")
    row = x.agg(*(F.percentile_approx(f, list(CUTS), 2000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted({float(v) for v in row[f] or []}) for f in FEATURES}
    cell = [sum((F.when(F.col(f) > t, 1).otherwise(0) for t in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]
    kept_apart = F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0
    n = lambda apart, q: F.count_if((kept_apart if apart else ~kept_apart) & ((F.col("quality") <= 0) if q else (F.col("quality") > 0)))
    counted = x.select("doc_id", "quality", *cell).groupBy(*FEATURES).agg(n(False, True).alias("a"), n(False, False).alias("b"), n(True, True).alias("c"), n(True, False).alias("d"))
    return {tuple(r[f] for f in FEATURES): (r["a"], r["b"], r["c"], r["d"]) for r in counted.collect()}, cuts


def verdict(rules: list[Rule]) -> Column:
    """What the first rule that holds says; True where none does."""
    out: Column | None = None
    for rule in rules:
        out = F.when(rule.column(), rule.keep) if out is None else out.when(rule.column(), rule.keep)
    return F.lit(True) if out is None else out.otherwise(True)


def apply_rules(docs: DataFrame, labels: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """One row per document: the counts, base_failed and kept."""
    stats = materialize(statistics(docs), "quality-statistics")
    if rules is None:
        rules = learn(*labelled_cells(stats, labels))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, False).otherwise(verdict(rules)).alias("kept"))
