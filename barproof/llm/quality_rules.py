"""Quality rules: fixed base rules, then a learned decision list.

Sequential covering learns conjunctions of thresholds that single out texts
labelled bad: each rule grows on two thirds of the rows left by the condition
of the highest information gain, is pruned from its end on the other third, and
is kept only if it is precise enough there; the rows it covers then go.  The
list is emitted as an ordered Spark conditional expression.

Learning takes at most ``sample`` labelled rows (those of the least hash of the
id; the bound is a parameter); counts and verdicts cover every text.

Defined results: a null or empty text has no words and fails the base rules;
without labels of both kinds the list is empty and everything that passes the
base is kept; repeated ids or rows give one row each; rows with a null or
conflicting label don't teach; very long texts are counted whole; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barproof.llm import docstats

SAMPLE = 20_000
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "digit_share", "upper_share", "mark_share", "long_share")
# the share of distinct words and the length are left out: they set long texts apart, good or bad


def features(counts: DataFrame) -> DataFrame:
    """Shares of each text, added to its counts."""
    c = F.col
    share = lambda a, b: F.round(c(a) / F.greatest(c(b), F.lit(1)), 6)
    return counts.withColumns({
        "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "digit_share": share("n_digits", "word_chars"), "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "n_words"), "distinct_share": share("n_distinct", "n_words"), "long_share": share("n_long", "n_words"),
    })


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def test(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.at_least else v <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.test(x)
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition of the highest gain (bad rows kept times the gain in log precision)."""
    p, n = bad.sum(), len(bad)
    base, best, found = np.log2(p / n), 1e-9, None
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], np.cumsum(bad[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        for at_least in (False, True):
            pk = (p - b[cut - 1] if at_least else b[cut - 1]).astype(float)
            nk = n - cut if at_least else cut
            gain = pk * (np.log2(np.maximum(pk, 1e-12) / nk) - base)
            if len(gain) and gain.max() > best:
                i = int(gain.argmax())
                best, found = gain[i], Condition(name, at_least, float(v[cut[i]] if at_least else v[cut[i] - 1]))
    return found


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, most_rules: int = 16, most_conditions: int = 4, least: int = 5) -> list[Rule]:
    """The decision list (rules for bad rows, in order)."""
    rules: list[Rule] = []
    held = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules:
        grow, prune = ~held, held
        if bad[grow].sum() < least:
            break
        rule: list[Condition] = []
        gx, gb = x[grow], bad[grow]
        while len(rule) < most_conditions and gb.any() and not gb.all():
            if (c := _best(gx, gb)) is None:
                break
            rule.append(c)
            keep = c.test(gx)
            gx, gb = gx[keep], gb[keep]
        px, pb = x[prune], bad[prune]

        def worth(r: Rule) -> tuple[float, int]:
            hit = _covers(r, px)
            p, n = int(pb[hit].sum()), int(hit.sum())
            return ((2 * p - n) / n if n else -1.0, -len(r))

        if not rule:
            break
        final = max((tuple(rule[:k]) for k in range(1, len(rule) + 1)), key=worth)
        hit = _covers(final, x)
        p, n = int(bad[hit].sum()), int(hit.sum())
        if n < least or p < precision * n or worth(final)[0] < 2 * precision - 1:
            break
        rules.append(final)
        x, bad, held = x[~hit], bad[~hit], held[~hit]
    return rules


def expression(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, from 1; 0 if none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def labelled(labels: DataFrame, label: Column, sample: int) -> DataFrame:
    """At most ``sample`` ids with one label each."""
    one = labels.select(F.col("doc_id").alias("doc_id"), label.cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    one = one.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def teach(docs: DataFrame, labels: DataFrame, label: Column, sample: int = SAMPLE) -> list[Rule]:
    """Learn from the sample's features; both sides of the join are cut to it before texts are read."""
    own = labelled(labels, label, sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id", "left_semi")
    rows = features(docstats.count_texts(texts)).join(F.broadcast(own), "doc_id").orderBy("doc_id").select("y", *FEATURES).toPandas()
    x, y = rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(int)
    return learn(x, y == 0) if len(y) and 0 < y.sum() < len(y) else []


def apply_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, counts, base_failed, rule (that fits first, or 0) and kept."""
    rules = teach(docs, labels, F.col("quality"), sample) if rules is None else rules
    out = features(docstats.count_texts(docs)).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("rule", expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
