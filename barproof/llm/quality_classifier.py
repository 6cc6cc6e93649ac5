"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each text.  Expectation-
maximisation estimates each heuristic's accuracy and the share of good texts;
it runs on counts of distinct vote patterns (at most 3^heuristics of them,
grouped over all texts), so each step is exact for the whole corpus and costs
the same at any size.  Which class is the good one is an assumption, stated here:
taken together, heuristics are right more often than wrong, so good is the class
in which fewer of them vote bad.  The posterior labels then train a linear scorer
on hashed words and hashed shapes, by at most ``sample`` distinct texts (those of
the least hash of id and text; the bound is a parameter), which come to the driver
as at most ``WIDTH`` hashed shares each, not as texts; scores cover every text.

The verdict needs both views: a text is dropped if its posterior is below
``least_posterior`` and its score below ``least_score``.  Heuristics that read the
same counts aren't independent, and EM, which takes them so, is too sure of texts
on which they err together; the scorer reads words instead.  A text without words
gives the scorer nothing to read, so its posterior alone decides.  Where
``surely_bad`` is set, a posterior of at most that drops a text by itself.

Votes and scorer are learned from ``docs``, or from ``fit_on`` where given.

Defined results: null and empty texts get votes like any other (they are bad);
where nothing can be learned from (an empty table) label and score are null and
every text is kept; repeated ids or rows give one row each and teach once; without
any text that has words the scorer knows its bias only; very long texts are read
whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barproof.llm import docstats, graph, quality_rules
from barproof.llm import repeats as rp
from barproof.llm import textkit as tk

SAMPLE, WIDTH = 4_000, 1 << 12
U64 = np.uint64


def votes(stats: DataFrame) -> DataFrame:
    """One column per heuristic: 1 good, -1 bad, 0 nothing."""
    vote = lambda bad, good: F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    c = F.col
    letters = 1 - (c("n_symbols") + c("n_digits") + c("n_marks")) / F.greatest(c("word_chars"), F.lit(1))
    return stats.withColumns({
        "v_length": vote(c("n_words") < 20, c("n_words") >= 50),
        "v_repeat": vote(100 * c("n_repeat_words") > 30 * c("n_words"), 100 * c("n_repeat_words") <= 5 * c("n_words")),
        "v_symbols": vote(c("symbol_share") > 0.05, c("symbol_share") < 0.01),
        "v_lines": vote(c("dup_line_share") > 0.3, c("dup_line_share") < 0.05),
        "v_marks": vote(c("mark_share") > 0.6, (c("mark_share") > 0.01) & (c("mark_share") < 0.3)),
        "v_letters": vote(letters < 0.85, letters > 0.93),
        "v_words": vote((c("word_length") > 6.5) | (c("word_length") < 3), c("word_length").between(4, 6)),
        "v_case": vote((c("upper_share") > 0.3) | (c("digit_share") > 0.2), (c("upper_share") < 0.1) & (c("digit_share") < 0.05)),
    })


VOTES = ("v_length", "v_repeat", "v_symbols", "v_lines", "v_marks", "v_letters", "v_words", "v_case")


def fit_accuracies(patterns: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray]:
    """Share of good texts and P(vote | good or bad) for each heuristic, as [heuristic, class, vote + 1]."""
    k = patterns.shape[1]
    table = np.empty((k, 2, 3))
    said, bad = np.maximum((patterns != 0).sum(1), 1), (patterns < 0).sum(1)
    p = np.where(bad > 0, 0.3 * (1 - bad / said), 0.9)  # to begin with, a bad vote makes a text doubtful, the more the larger its share
    for _ in range(rounds):
        good = float(np.clip((weight * p).sum() / weight.sum(), 0.01, 0.99))
        for y, q in ((1, weight * p), (0, weight * (1 - p))):
            for v in (-1, 0, 1):
                table[:, y, v + 1] = ((patterns == v) * q[:, None]).sum(0) + 1e-3
            table[:, y] /= table[:, y].sum(1, keepdims=True)
        p = posterior(patterns, good, table)
    if table[:, 1, 0].sum() > table[:, 0, 0].sum():  # the classes are named by which of them more heuristics call bad
        good, table = 1 - good, table[:, ::-1]
    return good, table


def posterior(patterns: np.ndarray, good: float, table: np.ndarray) -> np.ndarray:
    said = [np.log(p) + sum(np.log(table[j, y, patterns[:, j] + 1]) for j in range(patterns.shape[1])) for y, p in ((0, 1 - good), (1, good))]
    return 1 / (1 + np.exp(np.clip(said[0] - said[1], -50, 50)))


def hashed(buf: np.ndarray, offs: np.ndarray, weights: np.ndarray | None = None):
    """Hashed words and word shapes of texts: the mean weight of each, or (text, slot, share) entries."""
    n = len(offs) - 1
    starts, ends, doc = tk.word_spans(buf, offs)
    h = tk.span_hash(buf, starts, ends)
    shape = np.minimum(ends - starts, 30) + 31 * (docstats.SYMBOLS[buf[ends - 1]] * 2 + docstats.PUNCTUATION[buf[ends - 1]])
    slot = np.concatenate(((h % U64(WIDTH - 128)).astype(np.int64) + 128, shape))
    text = np.concatenate((doc, doc))
    many = np.maximum(np.bincount(doc, minlength=n), 1)
    if weights is not None:
        return np.bincount(text, weights=weights[slot], minlength=n) / many
    key, count = np.unique(text * WIDTH + slot, return_counts=True)
    return key // WIDTH, key % WIDTH, count / many[key // WIDTH]


def train(text: np.ndarray, slot: np.ndarray, share: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression to soft labels, by full-batch AdaGrad, on (text, slot, share) entries."""
    w, bias, seen = np.zeros(WIDTH), 0.0, np.full(WIDTH, 1e-6)
    if not len(y):
        return w, bias
    seen_b = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, weights=w[slot] * share, minlength=len(y)) + bias, -30, 30)))
        err = (p - y) / len(y)
        g = np.bincount(slot, weights=err[text] * share, minlength=WIDTH) + 1e-6 * w
        seen, seen_b = seen + g * g, seen_b + err.sum() ** 2
        w -= rate * g / np.sqrt(seen)
        bias -= rate * err.sum() / np.sqrt(seen_b)
    return w, bias


def _coded() -> Column:
    """A vote pattern as a number."""
    code = F.lit(0)
    for j, v in enumerate(VOTES):
        code = code + (F.col(v) + 1) * 3**j
    return code.cast("int")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least_posterior: float = 0.5, least_score: float = 0.5, surely_bad: float = 0.0, fit_on: DataFrame | None = None) -> DataFrame:
    """doc_id, label (posterior of the votes), score (of the linear scorer) and kept."""
    own = rp.whole(docs, id_col, text_col)
    seen = own if fit_on is None else rp.whole(fit_on, id_col, text_col)
    judged = lambda df: votes(quality_rules.features(df))
    with graph.Tables(docs) as tables:
        found = judged(docstats.count_texts(seen, "id", "text")).groupBy(*VOTES).count().toPandas()  # at most 3^8 patterns
        if not len(found):
            return own.select(F.col("id").alias("doc_id"), F.lit(None).cast("double").alias("label"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("kept"))
        fitted = fit_accuracies(found[list(VOTES)].to_numpy(int), found["count"].to_numpy(float))
        patterns = np.indices([3] * len(VOTES)).reshape(len(VOTES), -1).T - 1  # all there can be: ``docs`` may have others than ``fit_on``
        label = posterior(patterns, *fitted)
        known = docs.sparkSession.createDataFrame([(int(k), float(x)) for k, x in zip(((patterns + 1) * 3 ** np.arange(len(VOTES))).sum(1), label)], "code int, label double")
        labelled = lambda df: judged(df).withColumn("code", _coded()).join(F.broadcast(known), "code")  # noqa: E731  a row for each pattern

        # hashes first, then the texts of the chosen ones only, each once
        row = F.xxhash64("id", "text").alias("row")
        chosen = seen.select(row).distinct().orderBy("row").limit(sample)
        taught = seen.select(row, "text").join(F.broadcast(chosen), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
        taught = tables.keep(taught.select(F.col("row").alias("doc_id"), "text"))
        y = labelled(docstats.count_texts(taught)).select("doc_id", "label").orderBy("doc_id").toPandas()
        shares = taught.mapInArrow(_shares, "row long, slot int, share double").toArrow()
    place = np.searchsorted(y["doc_id"].to_numpy(), shares.column("row").to_numpy())
    w, bias = train(place, shares.column("slot").to_numpy(), shares.column("share").to_numpy(), y["label"].to_numpy(float))
    sent = docs.sparkSession.sparkContext.broadcast((w, bias))  # WIDTH weights
    schema = pa.schema([*docstats.SCHEMA, ("score", pa.float64())])

    def run(batches):
        w, bias = sent.value
        for batch in batches:
            buf, offs = tk.pack(batch.column("text"))
            for lo, hi in tk.slices(offs):
                b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                c = docstats.counts(b, o)
                s = 1 / (1 + np.exp(-np.clip(hashed(b, o, w) + bias, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *(pa.array(c[k], pa.int64()) for k in docstats.COUNTS), pa.array(s)], schema=schema)

    out = labelled(own.mapInArrow(run, docstats.SQL + ", score double"))
    bad = (F.col("label") <= surely_bad) | ((F.col("label") < least_posterior) & ((F.col("score") < least_score) | (F.col("n_words") == 0)))
    return out.select("doc_id", F.round("label", 6).alias("label"), F.round("score", 6).alias("score"), (~bad).alias("kept"))


def _shares(batches):
    for batch in batches:
        buf, offs = tk.pack(batch.column("text"))
        for lo, hi in tk.slices(offs):
            text, slot, share = hashed(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(text)), pa.array(slot, pa.int32()), pa.array(share)], ["row", "slot", "share"])
