"""The training-data operators against brute force on small and odd inputs."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import pytest

from barproof.llm import bpe, decontaminate, jaccard_join, language_id, quality_classifier, quality_rules, quotes, substring_dedup, suffix_dedup, textkit, url_filter

SPACE = "[^\x20\x09-\x0D]+"
BASE = " ".join(f"w{i * 7919 % 1000}" for i in range(90))
LINE = " ".join(f"line{i}" for i in range(20))
DOCS = [
    (1, BASE), (2, BASE), (3, BASE.replace("w7919", "x")), (4, "alpha beta " + LINE + " gamma"), (5, LINE + " delta"), (6, None), (7, ""), (8, "   \n\t"), (9, "one"), (10, "ONE"),
    (11, " ".join([LINE] * 4)), (12, "é" * 500 + " ü"), (13, "é" * 500), (14, "a b"), (15, BASE + " " + " ".join(f"tail{i}" for i in range(4000))),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in DOCS], "doc_id long, text string, id string, place string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df, n):
    return {r[0]: tuple(r)[1:n] for r in df.collect()}


FOOTER = " ".join(hashlib.md5(bytes([i])).hexdigest() for i in range(9))


def around(i):
    return " ".join(f"a{i * 131 + k}" for k in range(60)) + f" {FOOTER} " + " ".join(f"b{(i // 2) * 131 + k}" for k in range(80))


@pytest.mark.parametrize("heavy", [2, 1000])
def test_heavy_minimisers_give_the_same(spark, heavy):
    texts = [(i, around(i)) for i in range(40)] + [(50, around(3)), (51, around(7))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    words = {i: t.split() for i, t in texts}
    low, seen = {}, Counter(t.encode()[k : k + 400] for _, t in texts for k in range(len(t.encode()) - 399))
    for i, w in words.items():
        for k in range(len(w) - 12):
            low.setdefault(tuple(w[k : k + 13]), i)
    gone = {i: len({p for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}) for i, w in words.items()}
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_words(docs, chunk_bytes=4000, heavy=heavy).collect()} == gone
    gone = {i: len({p for k in range(len(t) - 399) if seen[t.encode()[k : k + 400]] > 1 for p in range(k, k + 400)}) for i, t in texts}
    assert any(gone.values()) and {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeated_bytes(docs, chunk_bytes=4000, heavy=heavy).collect()} == gone


@pytest.mark.parametrize("make", [lambda: substring_dedup.WordTrees(), lambda: suffix_dedup.ByteArrays()])
def test_windows_of_a_heavy_minimiser_are_spread(spark, make):
    import numpy as np
    import pyarrow as pa

    kit = make()
    texts = [around(2 * i) for i in range(300)]
    kit.ready(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), 16)
    buf, offs = textkit.pack(pa.array(texts))
    known, count = np.unique(kit.marks(buf, offs), return_counts=True)
    known = known[count > 100]
    heavy = np.ones(len(known), bool)
    assert len(known)
    sent = Counter()
    for table in kit.leaves(0, buf, offs, np.arange(300), known, heavy):
        for place, kind in zip(table.column("place").to_pylist(), table.column("kind").to_pylist()):
            assert kind in (1, 2)
            if kind == 2:
                sent[place] += 1
    assert len(sent) == 16 and max(sent.values()) < 2 * sum(sent.values()) / 16


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_substring_dedup(docs, empty):
    words = {i: (t or "").encode().split() for i, t in DOCS}
    low = {}
    for i, w in words.items():
        for k in range(len(w) - 12):
            low.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want[i] = (len(w), len(gone), sha(b" ".join(x for p, x in enumerate(w) if p not in gone)))
    assert rows(substring_dedup.remove_repeated_words(docs, chunk_bytes=2000), 4) == want
    assert substring_dedup.remove_repeated_words(empty).count() == 0


def test_suffix_dedup(docs, empty):
    texts = {i: (t or "").encode() for i, t in DOCS}
    seen = Counter(t[k : k + 400] for t in texts.values() for k in range(len(t) - 399))
    want = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want[i] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(t, gone) if not g)))
    assert rows(suffix_dedup.remove_repeated_bytes(docs, chunk_bytes=2000), 5) == want
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


@pytest.mark.parametrize(("k", "s"), [(3, "9/10"), (5, "4/5")])
def test_jaccard(docs, k, s):
    sets = {}
    for i, t in DOCS:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= Fraction(s) * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert rows(jaccard_join.jaccard_components(docs, k=k, similarity=s, chunk_bytes=2000), 3) == {i: (len(sets[i]), comp[i]) for i in sets}


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_bpe(docs, empty):
    tiktoken, tokens = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.read_ranks(tokens.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_and_decode(docs, ranks, tokens.PATTERN, place_bytes=2000)
    want = {i: (len(x := enc.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in DOCS}
    assert rows(out, 4) == want
    assert {r.doc_id: bytes(r.decoded or b"").decode() for r in bpe.decode(out, ranks).collect()} == {i: t or "" for i, t in DOCS}
    assert bpe.encode_and_decode(empty, ranks, tokens.PATTERN).count() == 0


ITEMS = [("a", LINE), ("b", "alpha beta line0"), ("c", None), ("d", ""), ("e", LINE + " extra"), (None, "delta")]


@pytest.mark.parametrize("most, at_once", [(8 << 20, 4), (200, 4), (20, 1)])
def test_decontamination(spark, docs, empty, most, at_once):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    split = lambda t: re.findall(word, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in ITEMS:
        w = split(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(i)
    want = {}
    for i, t in DOCS:
        w = split(t)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for j in range(len(w) - size + 1):
                if (x := tuple(w[j : j + size])) in windows:
                    hit |= set(range(j, j + size))
                    found |= windows[x] - {None}
        want[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w))
    sliced = {"most_bytes": most, "slices_a_pass": at_once}
    assert rows(decontaminate.decontaminate(docs, items, **sliced), 6) == want
    assert rows(decontaminate.decontaminate(docs, items, **sliced, full=False), 6) == want
    assert decontaminate.decontaminate(empty, items, **sliced).count() == 0
    # items, spans and kept words don't depend on slices either
    said = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    assert said(decontaminate.decontaminate(docs, items, **sliced)) == said(decontaminate.decontaminate(docs, items))


def test_quality_rules_learn_a_threshold():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.uniform(size=(600, len(quality_rules.FEATURES)))
    rules = quality_rules.learn(x, x[:, 1] > 0.7)
    assert [c.feature for c in rules[0]] == ["symbol_share"] and rules[0][0].threshold == pytest.approx(0.7, abs=0.02)
    assert quality_rules.learn(x, rng.uniform(size=600) < 0.5) == []


def test_classifier_separates(spark, empty):
    good = [(i, f"Plain words follow one another here, number {i}, and go on. " * 8) for i in range(60)]
    junk = [(100 + i, f"### $$$ &&& {i} *** %%% " * 20) for i in range(12)]
    out = {r.doc_id: r for r in quality_classifier.classify(spark.createDataFrame(good + junk, "doc_id long, text string")).collect()}
    assert max(r.score for i, r in out.items() if i >= 100) < min(r.score for i, r in out.items() if i < 100)
    assert quality_classifier.classify(empty).count() == 0


def test_language(spark):
    en, fr = "the quick brown fox and the lazy dog went there", "le petit chat et la grande maison sont dans une rue"
    data = [(i, f"{en} {i}", "en", "h.en") for i in range(20)] + [(50 + i, f"{fr} {i}", "fr", "h.fr") for i in range(20)] + [(90, "la maison et le chat", None, "h.fr"), (91, None, None, None), (92, "123 456", "en", "h.en")]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i].lang_found == "en" for i in range(20)) and all(out[50 + i].lang_found == "fr" for i in range(20))
    assert (out[90].lang_found, out[90].kept, out[91].kept, out[92].kept) == ("fr", True, False, False)


def test_url_rules(spark):
    urls = [(1, "http://www.Example.com/en/x"), (2, "http://a.example.com/en/"), (3, "https://b.net/fr/1?x"), (4, "http://x.org/a?b"), (5, None), (6, "no scheme"), (7, "http://com"), (8, "http://c.com#x")]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame([(*u, None) for u in urls], "page_id long, url string, html string")).collect()}
    assert out == {
        1: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/", "example.com/en/", "block"), 3: ("b.net", "/fr/1", "net/fr/", "block"),
        4: ("x.org", "/a", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("com", "", None, "allow"), 8: ("c.com", "", None, "allow"),
    }


def test_distrust_flows_back_along_links(spark):
    pages = [(1, "http://bad.net/fr/1", ""), (2, "http://x.org/a", '<a href="http://bad.net/q">'), (3, "http://good.com/z", '<a href="http://y.org/">'), (4, "http://y.org/", None)]
    out = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_quotes(spark):
    said = [(1, 0, "u", "Hello there\nhow are you"), (1, 1, "a", "> Hello  there\nfine"), (1, 2, "u", "> > Hello there\n> fine\nok"), (2, 0, "u", "> how are you\nelsewhere"), (2, 1, "u", None), (2, 2, "u", "> nothing known")]
    out = {(r.conv_id, r.turn): r for r in quotes.build_conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert [(out[k].parent_conv, out[k].parent_turn, out[k].depth, out[k].text) for k in ((1, 1), (1, 2), (2, 0))] == [(1, 0, 1, "fine"), (1, 1, 2, "ok"), (1, 0, 0, "elsewhere")]
    assert (out[2, 1].text, out[2, 2].n_linked) == (None, 0)
    assert sorted(out, key=lambda k: (k[0], out[k].path))[:3] == [(1, 0), (1, 1), (1, 2)]


def test_quotes_of_some_lines(spark):
    said = [
        (1, 0, "u", "a\nb\n\nc\nd"), (1, 1, "a", "> a\n> b\nyes"), (1, 2, "a", "> B\n>\n> c\nand"), (1, 3, "a", "> b\n> d\nno"), (1, 4, "a", "> d\n> e\nno"),
        (1, 5, "u", "> > b\n> > c\n> and\nfar"), (1, 6, "u", "x\r\n> and\r\ny\r\nz"), (1, 7, "u", "> x\n> y\nok"), (2, 0, "u", "> c\n> d\nelsewhere"),
    ]
    out = {(r.conv_id, r.turn): r for r in quotes.build_conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r.parent_conv, r.parent_turn, r.n_quotes, r.n_linked) for k, r in out.items() if r.n_quotes} == {
        (1, 1): (1, 0, 1, 1), (1, 2): (1, 0, 1, 1), (1, 3): (None, None, 1, 0), (1, 4): (None, None, 1, 0), (1, 5): (1, 2, 2, 2), (1, 6): (1, 2, 1, 1), (1, 7): (1, 6, 1, 1), (2, 0): (1, 0, 1, 1),
    }
    assert out[1, 1].path == "0000000000000000000/0000000000000000001"


def test_reply_paths_begin_at_the_root(spark):
    n = 150
    said = [(1, 0, "u", "line 0")] + [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, n)]
    out = {r.turn: r for r in quotes.build_conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    assert {i: r.depth for i, r in out.items()} == {i: i for i in range(n)}
    assert out[n - 1].path == "/".join(f"{i:019}" for i in range(n))


def test_mix_is_a_bijection():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)
    assert (textkit.unmix(textkit.mix(x)) == x).all()


def test_suffix_array_is_sorted():
    import numpy as np

    from barproof.llm.suffix_array import suffix_array, suffix_arrays

    rng = np.random.default_rng(0)
    for _ in range(60):
        offs = np.concatenate(([0], np.cumsum(rng.integers(0, 40, int(rng.integers(1, 30))))))
        a = rng.integers(0, int(rng.integers(1, 5)) + 1, offs[-1])
        assert suffix_arrays(a, offs).tolist() == [x + j for x, y in zip(offs[:-1], offs[1:]) for j in sorted(range(y - x), key=lambda i: a[x + i : y].tolist())]
    for _ in range(400):
        a = rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(0, 40)))
        assert suffix_array(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_a_heavy_prefix_is_cut_as_finely_as_it_must():
    """One two-word prefix holds nearly all: its grams go to thousands of groups, equal ones to one, and groups keep the order of prefixes."""
    import numpy as np

    from barproof.llm.substring_dedup import BINS, WordTrees

    kit, rng = WordTrees(), np.random.default_rng(0)
    kit.parts, kit.first = np.ones(BINS, np.int64), np.arange(BINS)
    kit.parts[5], kit.first[6:] = 4000, kit.first[6:] + 4000
    keys = np.concatenate((rng.integers(0, 2**48, 50_000) | 5 << 48, [6 << 48, 4 << 48])).astype(np.uint64)
    place = kit._place(textkit.mix(keys))
    assert len(set(place[:-2])) > 3990 and place[-2] > place[:-2].max() and place[-1] < place[:-2].min()
    assert (kit._place(textkit.mix(keys)) == place).all() and (np.diff(place[np.argsort(keys)]) >= 0).all()


def test_suffix_arrays_take_few_steps_of_python():
    """Whole arrays are sorted: steps grow with the logarithm of the longest repeat, not with strings or symbols."""
    import sys

    import numpy as np

    from barproof.llm.suffix_array import suffix_arrays

    rng, steps = np.random.default_rng(0), Counter()
    passage = rng.integers(1, 257, 3000)
    many = [np.concatenate((passage, rng.integers(1, 257, k), passage, [0])) for k in range(12)]
    for strings in ([np.concatenate((*many, np.ones(5000, np.int64)))], many):
        text, offs = np.concatenate(strings).astype(np.int16), np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        steps.clear()
        sys.setprofile(lambda frame, event, what: steps.update((event,)))
        try:
            order = suffix_arrays(text, offs)
        finally:
            sys.setprofile(None)
        assert steps.total() < 3000
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
            own = text[a:b].astype(">i2").tobytes()
            assert order[a:b].tolist() == [x + a for x in sorted(range(b - a), key=lambda i: own[2 * i :])]
