"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior for each text:

* the text: hashed byte trigrams, whose frequencies by language are counted over
  all labelled texts (65,536 slots for each language, whatever the corpus);
* the language that its own markup declares, weighed by how often each
  declaration goes with each language;
* the suffix of its address, and its host: shares of languages by grouped
  aggregation, host smoothed towards suffix and suffix towards all texts.

Shares and declarations are counted from the texts' own posteriors, so a label
isn't used twice.  A declaration is read as a language code:
before any count, it speaks for the label of that code (``trust`` texts' worth,
nineteen in twenty of them right).  A text is rejected if it has no letter or no
language reaches ``least``.  A text's trigrams aren't independent: a long text
counts as at most ``most_trigrams`` of them, so that hosts and declarations can
still turn it; a text in two languages is then less sure than it would be.

Labels are scored ``TOGETHER`` at a time, each slice with a broadcast table of
256 KB a label and a pass over the texts, so no broadcast grows with the number of
labels; trigrams are counted by the (label, slot) pairs that occur, in bounded
buffers.  What does grow: a text has one number a label, and there is a pass for
each ``TOGETHER`` labels, so labels should be languages, not free text.

Defined results: a null or letterless text has no language, posterior 0 and is
rejected; null hosts and declarations say nothing; without any label the result
has no language and rejects all; repeated ids or rows give one row each; very long
texts are read whole; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barproof.llm import graph
from barproof.llm import textkit as tk

SLOTS = 1 << 16
TOGETHER = 64
#: Counts of (label, slot) that a task holds before it sends them on.
MOST_PAIRS = 4_000_000
LOWER = np.arange(256, dtype=np.uint32)
LOWER[0x41:0x5B] += 32
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
MARKUP = r"(?i)<(?:html|body|article)\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,3})"


def host_of(address: Column) -> Column:
    """The host of a URL, or the whole of an address that is none."""
    host = F.regexp_extract(address, r"://([^/?#:]*)", 1)
    return F.lower(F.when(host != "", host).otherwise(address))


def suffix_of(host: Column) -> Column:
    """The last label of a host; none for a host of one label."""
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def trigrams(buf: np.ndarray) -> np.ndarray:
    b = LOWER[buf]
    return ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)


def _inside(offs: np.ndarray, total: int) -> np.ndarray:
    """Which trigrams lie within one text."""
    ok = np.ones(max(total - 2, 0), bool)
    cuts = offs[1:-1]
    for back in (1, 2):
        at = cuts - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def count_trigrams(texts: DataFrame) -> DataFrame:
    """(lang, slot, n) over rows (text, lang)."""

    def run(batches):
        langs: dict[str, int] = {}
        keys, counts, held = [], [], 0  # of (label, slot) pairs that occur, whatever the number of labels

        def merged() -> tuple[np.ndarray, np.ndarray]:
            all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
            order, first, _ = tk.groups_of(all_keys)
            return all_keys[order][first], np.add.reduceat(all_counts[order], first)

        def out() -> pa.RecordBatch:
            k, n = merged()
            names = pa.array(list(langs), pa.string()).take(pa.array(k // SLOTS))
            return pa.RecordBatch.from_arrays([names, pa.array((k % SLOTS).astype(np.int32)), pa.array(n)], ["lang", "slot", "n"])

        for batch in batches:
            code_of = np.fromiter((langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()), np.int64, batch.num_rows)
            buf, offs = tk.pack(batch.column("text"))
            for lo, hi in tk.slices(offs):
                b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                if len(b) < 3:
                    continue
                code = np.repeat(code_of[lo:hi], np.diff(o))[: len(b) - 2]
                own, n = np.unique((code * SLOTS + trigrams(b))[_inside(o, len(b))], return_counts=True)
                keys.append(own)
                counts.append(n)
                held += len(own)
                if held > MOST_PAIRS:
                    k, n = merged()
                    keys, counts, held = [k], [n], len(k)
                    if 2 * held > MOST_PAIRS:
                        yield out()
                        keys, counts, held = [], [], 0
        if held:
            yield out()

    return texts.select("text", "lang").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def _score(rows: DataFrame, sent, most_trigrams: int) -> DataFrame:
    """Adds the log likelihoods of a slice of labels to ``said`` (null for a text without letters)."""
    names = ["id", "host", "suffix", "declared", "text", "said"]

    def run(batches):
        logp = sent.value
        for batch in batches:
            buf, offs = tk.pack(batch.column("text"))
            said = []
            for lo, hi in tk.slices(offs):
                b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                n = np.maximum(np.diff(o) - 2, 0)
                letters = np.concatenate(([0], np.cumsum(LETTER[b])))
                letters = letters[o[1:]] - letters[o[:-1]]
                ll = np.zeros((hi - lo, len(logp)))
                if len(b) >= 3:
                    t = trigrams(b)
                    t[~_inside(o, len(b))] = SLOTS  # a slot that says nothing
                    for j in range(len(logp)):
                        total = np.concatenate(([0.0], np.cumsum(logp[j][t], dtype=np.float64), [0.0, 0.0]))
                        total[-2:] = total[-3]
                        ll[:, j] = (total[o[1:]] - total[o[:-1]]) / np.maximum(n, 1) * np.minimum(n, most_trigrams)
                said += [x if k else None for x, k in zip(ll.tolist(), letters.tolist())]
            if batch.column("said").null_count < batch.num_rows:
                said = [x if x is None else y + x for y, x in zip(batch.column("said").to_pylist(), said)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(said, pa.list_(pa.float64()))], names)

    return rows.mapInArrow(run, "id long, host string, suffix string, declared string, text string, said array<double>")


def _normal(logs: Column) -> Column:
    """Log weights -> probabilities."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", address_col: str | None = "source", declared: Column | None = None, least: float = 0.5, most_trigrams: int = 60, smoothing: float = 20.0, trust: float = 20.0) -> DataFrame:
    """doc_id, lang_found, posterior and kept of each text.  ``declared`` defaults to the markup's own declaration."""
    graph.shared_folder(docs)
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    host = host_of(docs[address_col].cast("string")) if address_col else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), host.alias("host"), suffix_of(host).alias("suffix"),
                       F.lower(F.nullif(declared if declared is not None else F.regexp_extract(text, MARKUP, 1), F.lit(""))).alias("declared"))
    labelled = docs.select(text.alias("text"), docs[label_col].cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    with graph.Tables(docs) as tables:
        found = tables.keep(count_trigrams(labelled))
        names = sorted(r[0] for r in found.select("lang").distinct().collect())  # the labels themselves
        if not names:
            return rows.select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("lang_found"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
        scored = rows.withColumn("said", F.lit(None).cast("array<double>"))
        for lo in range(0, len(names), TOGETHER):
            own = names[lo : lo + TOGETHER]
            table = found.where(F.col("lang").isin(own)).toArrow()  # 65,536 rows a label at most
            logp = np.full((len(own), SLOTS + 1), 0.5)
            label = np.array([own.index(x) for x in table.column("lang").to_pylist()], np.int64)
            logp[label, table.column("slot").to_numpy()] += table.column("n").to_numpy()
            logp = np.log(logp / logp.sum(1, keepdims=True)).astype(np.float32)
            logp[:, SLOTS] = 0
            scored = _score(scored, spark.sparkContext.broadcast(logp), most_trigrams)
        scored = tables.result(scored.drop("text"))

    # grouped aggregation of what the texts alone say
    own = scored.where("said IS NOT NULL").withColumn("p", _normal(F.col("said")))
    sums = [F.sum(F.col("p")[j]).alias(f"s{j}") for j in range(len(names))]
    part = own.groupBy("host", "suffix", "declared").agg(*sums).checkpoint()
    again = [F.sum(f"s{j}").alias(f"s{j}") for j in range(len(names))]
    arr = F.array(*[f"s{j}" for j in range(len(names))])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    everything = part.agg(*again).first()
    overall = np.array([everything[j] or 0.0 for j in range(len(names))]) + 1e-9
    overall = overall / overall.sum()
    base = F.array(*[F.lit(float(x)) for x in overall])
    smooth = lambda counts, towards: F.zip_with(counts, towards, lambda c, q: (c + smoothing * q) / (total(counts) + smoothing))
    by_suffix = part.where("suffix IS NOT NULL").groupBy("suffix").agg(*again).select("suffix", smooth(arr, base).alias("suffix_share"))
    by_host = part.where("host IS NOT NULL").groupBy("host", "suffix").agg(*again).join(by_suffix, "suffix", "left")
    by_host = by_host.select("host", smooth(arr, F.coalesce("suffix_share", base)).alias("host_share"))
    # P(declaration | language, some declaration), from the same sums and what a code means
    code = F.array(*[F.lit(re.split("[-_]", x.lower())[0]) for x in names])
    meant = F.transform(code, lambda x: (x == F.col("declared")).cast("double"))
    sure = F.transform(meant, lambda x: F.when(total(meant) == 0, 1.0 / len(names)).otherwise(0.95 * x / total(meant) + 0.05 / len(names)))
    declared_by = part.where("declared IS NOT NULL").agg(*again).first()
    many = F.array(*[F.lit(float(x or 0.0)) for x in declared_by])
    weight = F.zip_with(F.zip_with(arr, sure, lambda c, q: c + trust * q), many, lambda c, n: c / (n + trust))
    by_declared = part.where("declared IS NOT NULL").groupBy("declared").agg(*again).select("declared", weight.alias("declared_weight"))

    fused = scored.join(by_host, "host", "left").join(by_declared, "declared", "left")
    ln = lambda a: F.transform(a, lambda x: F.ln(x))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    nothing = F.array(*[F.lit(0.0)] * len(names))
    fused = fused.withColumn("p", _normal(plus(plus("said", ln(F.coalesce("host_share", base))), F.coalesce(ln("declared_weight"), nothing))))
    best = F.array_max("p")
    lang = F.array(*[F.lit(x) for x in names])
    sure = F.coalesce(best >= least, F.lit(False))
    return fused.select(F.col("id").alias("doc_id"), F.when(F.col("said").isNotNull(), F.element_at(lang, F.array_position("p", best).cast("int"))).alias("lang_found"), F.coalesce(F.round(best, 6), F.lit(0.0)).alias("posterior"), sure.alias("kept"))
