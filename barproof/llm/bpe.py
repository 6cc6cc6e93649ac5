"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A word here is one match of the tokenizer's pattern.  Texts become, once, blocks
of bounded size: positions into a small dictionary of the block's words.  A block
is named by its content.  It sends its distinct words to the bucket of their hash,
where each distinct word is encoded once; token ids come back in the order in
which the words were sent, and the texts' ids are put together by position.
Decoding joins the token-byte table, again by position.

A frequent word costs one entry for each block, never one for each occurrence.
Words travel packed, one parcel for each block and bucket.  Buckets grow with the
root of the number of blocks, so parcels grow with its power 1.5; parcels stream
through a bucket, which holds its distinct words only (and these grow slower than
texts).  Reading the input again must give its rows in the same order, as scans
do; a block that finds no answer fails rather than guesses.

Defined results: null text encodes as empty; a null id stays null; repeated ids
or rows give one row each; very long texts make a block of their own; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barproof.llm import repeats as rp
from barproof.llm import textkit as tk

# fixed values: classes of the tokenizer's pattern below U+0100, and Unicode's white space
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
NARROW_SPACE = "\t-\r \x85\xa0"
WIDE_SPACE = NARROW_SPACE + "  -     　"

SQL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def splitters(pattern: str):
    """The pattern for any text, and an equal but faster one for texts below U+0100."""
    wide = regex.compile(pattern.replace(r"[^\s", f"[^{WIDE_SPACE}").replace(r"(?!\S)", f"(?![^{WIDE_SPACE}])").replace(r"\s", f"[{WIDE_SPACE}]"))
    narrow = pattern.replace(r"[^\s", f"[^{NARROW_SPACE}").replace(r"(?!\S)", f"(?![^{NARROW_SPACE}])").replace(r"\s", f"[{NARROW_SPACE}]")
    narrow = re.sub(r"\[([^]]*)\]", lambda m: "[" + m[1].replace(r"\p{L}", LETTERS).replace(r"\p{N}", NUMBERS) + "]", narrow)
    narrow = narrow.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    return wide, re.compile(narrow)


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def _cut(lengths: np.ndarray, data: np.ndarray) -> list[bytes]:
    raw, ends = data.tobytes(), np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _begin(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths, dtype=np.int64) - lengths


def _sent(lengths: np.ndarray, data: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Which of a block's words go where."""
    starts = _begin(lengths)
    return [(int(k), at) for k, at in tk.split_by((tk.span_hash(data, starts, starts + lengths) % np.uint64(buckets)).astype(np.int64))]


def _listed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as one array, with starts and lengths."""
    data, lengths = _joined(words)
    return data, _begin(lengths), lengths


BLOCKS = pa.schema([("place", pa.int64()), ("blob", pa.binary())])
PARCELS = pa.schema([("bucket", pa.int64()), ("place", pa.int64()), ("blob", pa.binary())])
PARCELS_SQL = "bucket long, place long, blob binary"


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", place_bytes: int = 8 << 20, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (decimal, joined by a space) and of the decoded bytes; as ``outputs`` also ``ids`` and ``decoded``."""
    spark = docs.sparkSession
    docs = rp.whole(docs, id_col, text_col)
    buckets = math.ceil(8 * math.sqrt(rp.places_of(docs, place_bytes)))
    table = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    more = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary())}
    sql = SQL + "".join(f", {c} {more[c][0]}" for c in outputs)

    def blocks(batches):
        wide, narrow = splitters(pattern)
        for batch in batches:
            texts = batch.column("text")
            _, offs = tk.pack(texts)
            for lo, hi in tk.slices(offs, place_bytes):
                known: dict[str, int] = {}
                counts, at = [], []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    text = text or ""
                    found = (narrow if not text or max(text) < "\u0100" else wide).findall(text)
                    counts.append(len(found))
                    at += [known.setdefault(w, len(known)) for w in found]
                words, lengths = _joined([w.encode() for w in known])
                own = batch.column("id").slice(lo, hi - lo)
                some = own.is_valid().to_numpy(zero_copy_only=False)
                blob = tk.pressed(own.fill_null(0).to_numpy(zero_copy_only=False), some, np.array(counts, np.int32), np.array(at, np.int32), lengths.astype(np.int32), words)
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True)]), pa.array([blob], pa.binary())], schema=BLOCKS)

    def distinct(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        *_, lengths, data = tk.unpressed(t.column("blob")[0].as_py())  # blocks of one place are equal
        lengths, starts = lengths.astype(np.int64), _begin(lengths)
        return rp.rows(PARCELS, [(k, key[0].as_py(), tk.pressed(lengths[at].astype(np.int32), tk.gather(data, starts[at], lengths[at]))) for k, at in _sent(lengths, data, buckets)])

    def encode(batches):
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})._core_bpe
        known: dict[bytes, list[int]] = {}
        for batch in batches:  # parcels stream through; only distinct words stay
            for bucket, place, blob in zip(*(batch.column(c).to_pylist() for c in PARCELS.names)):
                ids = []
                for w in _cut(*tk.unpressed(blob)):
                    if (x := known.get(w)) is None:
                        x = known[w] = core.encode_single_piece(w)
                    ids.append(x)
                flat = np.fromiter((i for x in ids for i in x), np.uint32)
                flat = flat.astype(np.uint16) if not len(flat) or flat.max() <= 0xFFFF else flat
                yield from rp.rows(PARCELS, [(bucket, place, tk.pressed(np.fromiter(map(len, ids), np.int32, len(ids)), flat))]).to_batches()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [(c, more[c][1]) for c in outputs])

    def assemble(t: pa.Table, coded: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        own, some, counts, at, lengths, data = tk.unpressed(t.column("blob")[0].as_py())
        reply = {k: tk.unpressed(b) for k, b in zip(coded.column("bucket").to_pylist(), coded.column("blob").to_pylist())}
        # the ids of every distinct word, end to end
        sent = _sent(lengths.astype(np.int64), data, buckets)
        many, first = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        flat, held = [np.zeros(0, np.int64)], 0
        for k, words in sent:
            n, ids = reply[k]
            many[words], first[words] = n, held + _begin(n)
            flat.append(ids.astype(np.int64))
            held += len(ids)
        flat = np.concatenate(flat)
        # what each token stands for, as bytes and as a number
        token = {i: b for b, i in table.value.items()}
        some_ids = np.unique(flat)
        code = np.searchsorted(some_ids, flat)
        meant = _listed([token[i] for i in some_ids.tolist()])
        said = _listed([b"%d " % i for i in some_ids.tolist()])
        ends, out = np.cumsum(counts).tolist(), []
        for (doc, is_id), a, b in zip(zip(own.tolist(), some.tolist()), [0, *ends], ends):
            n_tokens, shas, parts = 0, (hashlib.sha256(), hashlib.sha256()), []
            held_back = b""
            for lo in range(a, b, 1 << 17):  # a very long text by pieces
                p = at[lo : min(b, lo + (1 << 17))]
                ids = code[tk.ranges(first[p], many[p])]
                n_tokens += len(ids)
                shas[0].update(held_back)
                number = tk.gather(said[0], said[1][ids], said[2][ids])
                shas[0].update(number[:-1])
                held_back = b" "
                text = tk.gather(meant[0], meant[1][ids], meant[2][ids])
                shas[1].update(text)
                if outputs:
                    parts.append((some_ids[ids].astype(np.int32) if "ids" in outputs else None, text.tobytes() if "decoded" in outputs else None))
            row = (doc if is_id else None, n_tokens, shas[0].hexdigest(), shas[1].hexdigest())
            whole = {"ids": lambda parts=parts: np.concatenate([np.zeros(0, np.int32), *(x for x, _ in parts)]), "decoded": lambda parts=parts: b"".join(x for _, x in parts)}
            out.append((*row, *(whole[c]() for c in outputs)))
        return rp.rows(schema, out * t.num_rows)

    by = docs.mapInArrow(blocks, "place long, blob binary").groupBy("place")
    coded = by.applyInArrow(distinct, PARCELS_SQL).repartition(buckets, "bucket").mapInArrow(encode, PARCELS_SQL)
    return by.cogroup(coded.groupBy("place")).applyInArrow(assemble, sql)


def decode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of an array of token ids, by a join with the token-byte table; an unknown id gives null."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "token int, bytes binary")
    one = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    long = one.select("row", F.posexplode("ids").alias("pos", "token")).join(F.broadcast(table), "token", "left")
    whole = long.groupBy("row").agg(F.count("bytes").alias("n"), F.count(F.lit(1)).alias("all"), F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("x")))).alias("parts"))
    text = F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), ""))
    bytes_ = F.when(F.size("ids") == 0, F.lit(b"")).when(F.col("n") == F.col("all"), text)
    return one.join(whole, "row", "left").select("doc_id", bytes_.alias("decoded"))
