"""The learners of op5 and op10 and the rules of op8 against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barproof.llm import quality_classifier as qc
from barproof.llm import quality_rules as qr
from barproof.llm import textkit as tk
from barproof.llm import url_filter


def brute_best(x, bad):
    """The highest gain of any condition on any seen value."""
    base, best = math.log2(bad.sum() / len(bad)), 0.0
    for j in range(x.shape[1]):
        for v in sorted(set(x[:, j])):
            for hit in (x[:, j] >= v, x[:, j] <= v):
                p, n = int(bad[hit].sum()), int(hit.sum())
                if 0 < n < len(bad) and p:
                    best = max(best, p * (math.log2(p / n) - base))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_a_condition_has_the_highest_gain(seed):
    """With ties in every feature."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (60, len(qr.FEATURES))).astype(float) / 5
    bad = rng.random(60) < 0.2 + 0.5 * (x[:, seed % 8] > 0.5)
    c, base = qr._best(x, bad), math.log2(bad.sum() / len(bad))
    hit = c.test(x)
    assert bad[hit].sum() * (math.log2(bad[hit].sum() / hit.sum()) - base) == pytest.approx(brute_best(x, bad))
    assert qr._best(np.zeros_like(x), bad) is None


@pytest.mark.parametrize("seed", range(4))
def test_rules_are_precise_ordered_and_fit_on_what_is_left(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((900, len(qr.FEATURES))), 2)
    bad = ((x[:, 1] > 0.8) & (x[:, 3] < 0.6)) | (x[:, 5] > 0.95)
    rules = qr.learn(x, bad)
    left = np.ones(len(x), bool)
    assert rules
    for rule in rules:
        hit = qr._covers(rule, x) & left
        assert 1 <= len(rule) <= 4 and hit.sum() >= 5 and bad[hit].sum() >= 0.9 * hit.sum()
        left &= ~hit
    assert bad[left].sum() < 0.2 * bad.sum()
    rows = [(k, *map(float, r)) for k, r in enumerate(x[:200])]
    got = {r.k: r.rule for r in spark.createDataFrame(rows, ["k", *qr.FEATURES]).select("k", qr.expression(rules).alias("rule")).collect()}
    assert got == {k: next((n for n, rule in enumerate(rules, 1) if qr._covers(rule, x[k : k + 1])[0]), 0) for k in range(200)}


def test_no_rule_where_labels_say_nothing():
    rng = np.random.default_rng(1)
    assert qr.learn(rng.random((300, len(qr.FEATURES))), rng.random(300) < 0.3) == []


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


TEXTS = ["plain words of a text", "", " \n ", "### $$$ ###", "a, b. c!", "same same same", "word " * 30_000, "x" * 5000]


def slots_of(text):
    words = [w for w in text.encode().split()]
    out = []
    for w in words:
        buf = np.frombuffer(w, np.uint8)
        h = int(tk.span_hash(buf, np.array([0]), np.array([len(w)]))[0])
        last = chr(w[-1])
        out += [h % (qc.WIDTH - 128) + 128, min(len(w), 30) + 31 * (2 * (last in "#*$%&|<>") + (last in ".,;:!?"))]
    return out, max(len(words), 1)


def test_scores_are_mean_weights_of_words_and_shapes():
    w = np.random.default_rng(0).normal(size=qc.WIDTH)
    got = qc.hashed(*packed(TEXTS), w)
    for text, score in zip(TEXTS, got):
        slots, many = slots_of(text)
        assert score == pytest.approx(sum(w[s] for s in slots) / many, abs=1e-9)
    text, slot, share = qc.hashed(*packed(TEXTS))
    for k, t in enumerate(TEXTS):
        slots, many = slots_of(t)
        assert dict(zip(slot[text == k].tolist(), share[text == k].tolist())) == pytest.approx({s: slots.count(s) / many for s in set(slots)})


def test_training_is_adagrad_on_the_soft_labels():
    rng = random.Random(4)
    data = [{rng.randrange(12): rng.random() for _ in range(4)} for _ in range(30)]
    y = [0.9 if 3 in d else 0.1 for d in data]
    text, slot, share = (np.array(c) for c in zip(*((k, s, v) for k, d in enumerate(data) for s, v in d.items())))
    w, bias = qc.train(text, slot, share, np.array(y), rounds=25)
    own, b, seen, seen_b = [0.0] * 12, 0.0, [1e-6] * 12, 1e-6
    for _ in range(25):
        err = [(1 / (1 + math.exp(-(sum(own[s] * v for s, v in d.items()) + b))) - t) / len(y) for d, t in zip(data, y)]
        g = [sum(e * d.get(s, 0.0) for e, d in zip(err, data)) + 1e-6 * own[s] for s in range(12)]
        seen, seen_b = [a + x * x for a, x in zip(seen, g)], seen_b + sum(err) ** 2
        own, b = [a - x / math.sqrt(q) for a, x, q in zip(own, g, seen)], b - sum(err) / math.sqrt(seen_b)
    assert w[:12] == pytest.approx(own, abs=1e-9) and bias == pytest.approx(b) and not w[12:].any()


def test_the_verdict_follows_label_and_score(spark):
    """The limits given; a long text beside short ones."""
    good = "The committee met on Tuesday to discuss the budget, and several members asked questions about it. "
    rows = [(k, good * (1 + k % 4) + f"Item number {k}.") for k in range(60)] + [(100 + k, "$$$ ### WIN %% " * (5 + k)) for k in range(12)] + [(200, good * 3000), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in qc.classify(df, least_posterior=0.4, least_score=0.6, surely_bad=0.05).collect()}
    assert len(out) == len(rows)
    for r in out.values():
        assert r.kept == (not (r.label <= 0.05 or (r.label < 0.4 and r.score < 0.6)))
    assert out[200].kept and not any(out[100 + k].kept for k in range(12))


def test_both_views_are_needed_to_drop_a_text(spark):
    """Defaults: the scorer overrules heuristics that err together; without words the posterior alone decides."""
    good = "The committee met on Tuesday to discuss the budget, and several members asked questions about it. "
    rows = [(k, good * (1 + k % 4) + f"Item number {k}.") for k in range(60)] + [(100 + k, "$$$ ### WIN %% " * (5 + k)) for k in range(12)] + [(200, good.upper()), (201, None), (202, " \n ")]
    out = {r.doc_id: r for r in qc.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    for r in out.values():
        assert r.kept == (not (r.label < 0.5 and (r.score < 0.5 or r.doc_id in (201, 202))))
    assert not any(out[k].kept for k in (*range(100, 112), 201, 202)) and all(out[k].kept for k in range(60))


def test_what_is_learned_from_some_texts_holds_for_others(spark):
    """Held out: votes and scorer are learned from one half, without labels, and judge the other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for half in (0, 1):
        got = qc.classify(docs.where(F.col("half") != half), fit_on=docs.where(F.col("half") == half))
        assert got.count() == docs.where(F.col("half") != half).count()
        share = {r.quality: r.dropped for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg((~F.col("kept")).cast("int")).alias("dropped")).collect()}
        assert share[0] >= 0.6 and share[1] <= 0.03, share


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert [(r.label, r.score, r.kept) for r in qc.classify(df, fit_on=df.limit(0)).collect()] == [(None, None, True)] * 3


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for said, rule in url_filter.RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return host, path, best


def test_urls_against_plain_python(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.example.com", "xexample.com", "a.b.net", "net", "NET", "Example.COM", "example.com.", "ÉXAMPLE.com", "", "org", "user@example.com", "example.com:80"]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/es/", "/fr/q", "/es", "//en/", "/x/es/"]
    urls = ["http" + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/en/", "#/es/", "?a#b", "\nx"]) for _ in range(600)] + [None, "", "example.com/en/", "://com", "a://b://example.com/en/", "http:///en/"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    for r in url_filter.filter_urls(df).collect():
        host, path, best = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), urls[r.page_id]
        assert best is None or r.verdict == best[0]
