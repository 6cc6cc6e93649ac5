"""Filter interactions, token ids in planes and the Merkle manifest against plain Python, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barproof.llm import filter_audit, id_planes, merkle

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"l{i * 7919 % 5000}" for i in range(30_000))
HOT = "a passage that very many documents hold"
ROWS = [
    (1, HOT, "en", "h", 7), (2, HOT, "en", "h", None), (2, HOT, "en", "h", None), (3, HOT.upper(), None, None, 1), (4, None, "en", "h", 0), (5, "", "", "", 0), (6, " \n\t ", None, "h", 4), (7, LONG, "de", "h", 9), (8, LONG, "de", "g", 9),
    (None, HOT, "en", "h", 1), (None, HOT, "en", "h", 1), (None, None, None, None, None), (None, "only here", "fr", "h", 1), (9, "one\ntwo\n\nthree # $", "fr", "h", 3), (10, "Ünïcödé 日本語 × ÷ " * 30, "fr", "i", 3), (11, "it's <|endoftext|> they'll\r\n  go", "fr", "i", 3),
    *[(i, HOT, "en", "h", i) for i in range(40, 100)], *[(i, f"text {i % 7}\nmore", "es", f"s{i % 5}", i) for i in range(100, 140)],
]
CLASH = ("id", "part", "mask", "fp", "row", "grp", "n", "i", "h", "now", "block", "ids", "place", "level", "path")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def make(spark):
    def build(rows, parts=5):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return df.select("*", *[F.lit("clash").alias(c) for c in CLASH]).repartition(parts)

    return build


@pytest.fixture
def many_ranges(spark):
    """Small tables in as many partitions as large ones have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def masks_of(rows):
    out = []
    for doc, text, lang, *_ in rows:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        copy = any((t or "") == text and i is not None and (doc is None or i < doc) for i, t, *_ in rows)
        out.append((doc, lang or "", (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + 8 * bool(re.search("[#$%&*|]", text)) + 16 * copy))
    return out


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, 1, 1), (50, 1, None), (51, None, 1), (None, 1, 1), (9, 1, 1), (9, 1, 1)]


def test_masks(make, many_ranges):
    got = Counter(tuple(r) for r in filter_audit.failures(make(ROWS)).collect())
    assert got == Counter(masks_of(ROWS))
    assert sum(n for (_, _, m), n in got.items() if m & 16) > 60


@pytest.mark.parametrize("same_id", [False, True])
def test_copies_over_many_ranges(make, many_ranges, same_id):
    """One text in all rows: a range's rows have their copies in ranges before; with one id for all, none is a copy."""
    rows = [(5 if same_id else i, "x", "en", None, None) for i in range(300)]
    got = Counter(bool(r["mask"] & 16) for r in filter_audit.failures(make(rows)).collect())
    assert got == ({False: 300} if same_id else {False: 1, True: 299})


def test_audit(spark, make):
    good, toxic = {i for i, q, _ in LABELS if q == 1 and i is not None}, {i for i, _, x in LABELS if x == 1 and i is not None}
    want, removed_by = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {lang or "" for _, _, lang, *_ in ROWS}:
            left = [(d, m) for d, p, m in masks_of(ROWS) if p == part]
            every = left
            for step, x in enumerate(order, 1):
                bit = 1 << "ABCDE".index(x)
                gone, kept = [y for y in left if y[1] & bit], [y for y in left if not y[1] & bit]
                removed_by[part, x] += len(gone)
                want[part, "".join(order), step] = (len(kept), len(gone), sum(1 for _, m in every if m & bit) - len(gone), sum(1 for _, m in every if m == bit), sum(1 for d, _ in gone if d in good), sum(1 for d, _ in gone if d in toxic))
                left = kept
    got = filter_audit.audit(make(ROWS), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for r in got} == want
    assert all(r.shapley == removed_by[r.part, r.filter_order[r.step - 1]] for r in got) and len(got) == len(want)
    assert filter_audit.audit(make([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_pieces_are_those_of_the_library():
    rng, signs = random.Random(1), ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "b", "é", "×", "1", "2", "!", "''", "ſ", "\xa0", " ", "日本", "<|", "<|endoftext|>", "\x1c", "\x85", "÷", "\0", "'v", "'ve"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(4000)]
    ids, counts = id_planes.pieces_of(PATH).encode(pa.array(texts))
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [w.ids for w in want]


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    monkeypatch.setattr(id_planes, "MOST_PIECES", 5)
    known = id_planes.Pieces(PATH)
    for text in ("one two three", "four five six", "one two three seven"):
        assert known.encode(pa.array([text]))[0].tolist() == known.plain(text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 4097])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 8 else 50_257, n).astype(np.uint32)
    planes = id_planes.to_planes(ids, kind)
    assert len(planes) == (4 if kind == "byte" else 32) and id_planes.from_planes(planes, n).tolist() == ids.tolist()
    assert n == 8 or not any(planes[2:] if kind == "byte" else planes[16:])


def test_checksums_of_pieces_join():
    data = random.Random(3).randbytes(5000)
    for cuts in ([], [0, 0], [1], [4, 2500, 4999], [5000]):
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        assert id_planes.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


@pytest.mark.parametrize(("kind", "block", "part"), [("byte", 64, 5000), ("bit", 1 << 16, 1 << 24)])
def test_files(spark, make, tmp_path, kind, block, part):
    own = Tokenizer.from_file(PATH)
    coded = [(i, [*own.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in ROWS]
    folder = str(tmp_path / "ids")
    id_planes.write_ids(make(ROWS), folder, PATH, end_id=2, kind=kind, block=block, part=part)
    got = id_planes.read_documents(spark, folder, ids=True).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(x)) for i, x in coded)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    known = [r.doc_id for r in got]
    assert known == sorted(known, key=lambda i: (i is None, i or 0))
    slim = Counter(tuple(r) for r in id_planes.read_documents(spark, folder).collect())
    assert slim == Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got)
    flat = [i for r in got for i in r.ids]
    index = id_planes.read_index(spark, folder).orderBy("start").collect()
    assert [r.start for r in index] == list(np.cumsum([0, *[r.n for r in index]])[:-1]) and sum(r.n for r in index) == at
    assert all(r.n == block for a, r in zip(index[1:], index) if a.part == r.part)
    lo, hi = at // 3, at // 3 + 500
    assert [i for r in id_planes.read_range(spark, folder, lo, hi).orderBy("start").collect() for i in r.ids] == flat[lo:hi]


def test_files_of_no_documents(spark, make, tmp_path):
    folder = str(tmp_path / "ids")
    id_planes.write_ids(make([]), folder, PATH, end_id=2)
    assert id_planes.read_documents(spark, folder).count() == 0 and id_planes.read_index(spark, folder).count() == 0


def test_a_damaged_block_is_an_error(spark, make, tmp_path):
    folder = str(tmp_path / "ids")
    id_planes.write_ids(make(ROWS[:9]), folder, PATH)
    blocks = spark.read.schema(id_planes.BLOCKS_SQL).parquet(f"{folder}/blocks").withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="damaged"):
        id_planes.read_pieces(blocks).collect()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, tampered):
    """(doc_id, leaf) -> rows; leaves of one id in the order of their hashes."""

    def climbed(hashes):
        """The top, and for each entry its (left, right) siblings up to it."""
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
        while len(level) > 1:
            for k, p in zip(at, paths):
                lo = k - k % 3
                p.append(("".join(level[lo:k]), "".join(level[k + 1 : lo + 3])))
            level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
            at = [k // 3 for k in at]
        return level[0] if level else None, paths

    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, tampered(r[0], r[1]))))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = [climbed([x[2] for x in sorted(groups[k])]) for k in keys]
    root, upper = climbed([t for t, _ in tops])
    out = Counter()
    for k, (subroot, paths), above in zip(keys, tops, upper):
        for (some, doc, own, now), path in zip(sorted(groups[k]), paths):
            steps, acc = path + above, now
            for left, right in steps:
                acc = sha(left + acc + right)
            out[doc if some else None, own, subroot, root, sha("".join(a + b for a, b in steps)), acc, acc == root] += 1
    return out


def cut(doc, text):
    return text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:2], [(i, "x\n", "en", "one", i) for i in range(82)], [(i, "x", "en", f"s{i:03}", i) for i in range(28)]])
def test_manifest(make, many_ranges, rows):
    got = Counter(tuple(r) for r in merkle.manifest(make(rows), merkle.without_line_ends).drop("proof").collect())
    assert got == brute_manifest(rows, cut)


def test_manifest_of_nothing_and_without_changes(make):
    assert merkle.manifest(make([])).count() == 0
    out = merkle.manifest(make(ROWS), fanout=2)
    assert out.where("NOT verified OR verified IS NULL").count() == 0 and out.count() == len(ROWS)
