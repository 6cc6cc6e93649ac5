"""The pipeline, stage by stage, against brute force."""

import hashlib
import re
from collections import Counter

import pytest

from barproof.llm import bpe, language_id
from tests_llm_brute import brute_components

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tiktoken, tokens = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")


def texts():
    word = lambda i, k: hashlib.md5(f"{i} {k}".encode()).hexdigest()[: 3 + (i * k) % 6]
    make = lambda i, n: " ".join(word(i, k) for k in range(n))
    shared, item = make(900, 120), make(901, 16)
    out = {i: "the plain words of number " + make(i, 60 + i) for i in range(30)}
    out |= {40: out[3], 41: out[4] + " tail", 42: out[5], 43: out[4] + " tail of it"}
    out |= {50: "the one " + shared + " " + make(50, 20), 51: make(51, 30) + " " + shared, 52: make(52, 10) + " " + item, 53: make(53, 900) + " " + item, 54: None, 55: "", 56: "1234 5678"}
    return out, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, item = texts()
    docs = [(i, t, "en", "h.en", len(t or ""), [i, 1], "clash") for i, t in rows.items()] + [(None, rows[6] + " more words of another row", "en", "h.en", 1, None, None)] * 2 + [(7, rows[7], "en", "h.en", len(rows[7]), [7, 1], "clash")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int, extra array<int>, id string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def listed(df, *columns):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*columns).collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
        after.append((name, docs))
        assert name == "byte_bpe" or docs.columns == columns
    language, near, cut, clean, coded = (d for _, d in after)
    start = spark.read.parquet(f"{folder}/documents.parquet")

    kept = {r.doc_id for r in language_id.identify(start).where("kept").collect()}
    assert listed(language, "doc_id", "text", "extra", "id") == Counter({k: n for k, n in listed(start, "doc_id", "text", "extra", "id").items() if k[0] in kept}) and not {54, 55, 56} & kept

    rows = [(r.doc_id, r.text) for r in language.collect()]
    order = sorted(range(len(rows)), key=lambda a: (rows[a][0] is None, rows[a][0] or 0))
    groups = brute_components([(n, rows[a][1]) for n, a in enumerate(order)], 5, "4/5")
    first = [rows[order[n]] for n, _, c in groups if n == c]
    assert listed(near, "doc_id", "text") == Counter(first) and len(first) < len(rows)
    assert {i for i, _ in first} & {40, 41, 42, 43} == set()

    data = [(r.doc_id, r.text.encode()) for r in near.collect()]
    seen, want = Counter(t[k : k + 400] for _, t in data for k in range(len(t) - 399)), Counter()
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        text = bytes(x for x, g in zip(t, gone) if not g).decode(errors="ignore")
        want[i, text, len(text)] += 1
    assert listed(cut, "doc_id", "text", "n_chars") == want and want != Counter((i, t.decode(), len(t.decode())) for i, t in data)

    split = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", t.lower())
    item = split(texts()[1])
    windows = {tuple(item[j : j + 13]) for j in range(len(item) - 12)}
    bad = set()
    for i, t, _ in want:
        w = split(t)
        hit = {p for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for p in range(j, j + 13)}
        bad |= {i} if hit and 20 * len(hit) >= len(w) else set()
    assert bad == {52} and listed(clean, "doc_id", "text") == Counter({(i, t): n for (i, t, _), n in want.items() if i not in bad})

    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.read_ranks(tokens.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert listed(coded, "doc_id", "n_tokens", "decoded_sha256") == Counter((r.doc_id, len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in clean.collect())
    assert coded.columns == [*columns, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and listed(coded, *columns) == listed(clean, *columns)
    assert all(r.token_ids == enc.encode_ordinary(r.text) for r in coded.collect())


def test_run_and_odd_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    known = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL").collect()}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.read_ranks(tokens.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = out.collect()
    assert len(rows) > 25 and all(enc.decode(r.token_ids) == r.text and r.n_tokens == len(r.token_ids) for r in rows)
    assert all((r.lang, r.source, r.extra, r.id) == (known[r.doc_id].lang, known[r.doc_id].source, known[r.doc_id].extra, known[r.doc_id].id) for r in rows if r.doc_id is not None)
    few = spark.createDataFrame([(1, "the plain words"), (None, None)], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:  # no other column, and nothing left
        assert stage(spark, few, folder).count() <= 2
        assert stage(spark, few.limit(0), folder).count() == 0


def test_rows_that_share_a_hash_are_named_anew(spark, monkeypatch):
    """A first hash of a few values only."""
    from pyspark.sql import functions as F

    real = F.xxhash64

    class Few:
        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, *columns):
            return real(*columns) % 3 if len(columns) == 4 else real(*columns)

    monkeypatch.setattr(corpus_pipeline, "F", Few())
    docs = spark.createDataFrame([(i, t) for i in (1, 2, 3, 4, None) for t in ("a", "b", "\0null", None, "")] + [(1, "a")], "doc_id long, text string")
    rows = {}
    for r in corpus_pipeline.with_row(docs).collect():
        rows.setdefault(r[corpus_pipeline.ROW], set()).add((r.doc_id, r.text))
    assert len(rows) == 25 and all(len(x) == 1 for x in rows.values())
