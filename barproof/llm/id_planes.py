"""Token ids as files of bit or byte planes.

1. *Encode.*  Texts are cut by the tokenizer's pattern; each distinct piece goes
   through the tokenizers library once a worker (a cache of bounded size), the ids
   of all pieces are put together by position, and an end id follows each document.
2. *Order.*  Encoded rows are range-sorted by doc_id into parts of bounded size.
3. *Planes.*  A part is a sequence of blocks of a fixed number of ids (its last one
   shorter).  A block is transposed: plane k has bit k, or byte k, of every id.  Each
   plane is compressed by zstandard on its own; planes of zeros only take no bytes.
   Blocks go on across documents, and documents across blocks.
4. *Index.*  For each block: part, number, first id's place in the whole sequence,
   ids, bytes of each plane and a checksum, so a range of ids needs its blocks only.

Files are Parquet, one row a block, planes unchanged inside it, so any store that
Spark writes to holds them, and a lost executor's part is written again.  Where parts
begin is the one thing the driver adds up: a number a part.

Defined results: a null text is empty and has the end id only; a null id comes after
all others; rows of one id stand in the order of their number of ids and ids' hash;
repeated rows are documents of their own; very long texts are split over blocks; an
empty table writes and reads no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barproof.llm import bpe, graph
from barproof.llm import repeats as rp
from barproof.llm import textkit as tk

#: Ids in a block, and about how many of them in a part.
BLOCK, PART = 1 << 16, 1 << 24
#: Pieces that a worker remembers.
MOST_PIECES = 2_000_000

# classes of bytes, in texts of ASCII and the letters of Latin-1
LETTER, NUMBER, BLANK, SPACE, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = LETTER
CLASS[0x30:0x3A] = NUMBER
CLASS[0x20] = BLANK
CLASS[0x09:0x0E] = SPACE
#: Bytes that begin other characters.
FOREIGN = np.zeros(256, bool)
FOREIGN[[*range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin, in texts whose characters are ASCII or Latin-1 letters.

    A piece is a contraction, or a run of letters, digits or other signs with the one
    blank before it, or a run of white space without its last character if more follows.
    """
    n = len(buf)
    kind = CLASS[buf]
    head = np.zeros(n + 1, bool)  # a text begins or all end
    head[offs] = True
    white = (kind == BLANK) | (kind == SPACE)
    begin = head[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begin[1:][white[1:] & white[:-1] & ~head[1:-1]] = False  # white space is one run
    last = white & ~head[1:]  # the last of a run, with more behind it
    last[:-1] &= ~white[1:]
    begin |= last
    begin[1:][last[:-1] & (kind[:-1] == BLANK)] = False  # the blank goes with what follows
    quote = np.flatnonzero(begin & (buf == 0x27))
    if len(quote):
        ends = offs[np.searchsorted(offs, quote, "right")]
        at = lambda k: np.where(quote + k < ends, buf[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        short = np.isin(one, list(b"stmd"))
        long = ((two == ord("e")) & np.isin(one, list(b"rv"))) | ((one == ord("l")) & (two == ord("l")))
        for found, size in ((short, 2), (long & ~short, 3)):
            q = quote[found]
            begin[q + 1] = False
            begin[(q + size)[q + size < n]] = True
    return np.flatnonzero(begin)


class Pieces:
    """The ids of pieces, by the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[[*vocabulary.values()]] = [*map(len, vocabulary)]  # byte-level tokens have a sign a byte
        self.pattern = bpe.splitters(bpe_pattern(path))[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.many = np.zeros(0, np.uint32), np.zeros(0, np.int32)  # of all known pieces, end to end

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Where each piece stands among the known ones, after the new ones are encoded."""
        if len(self.known) + len(pieces) > MOST_PIECES:
            self.forget()
        new = [p for p in pieces if p not in self.known]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        ids, many = [self.ids], [self.many]
        for lo in range(0, len(new), 1000):
            some = new[lo : lo + 1000]
            ids.append(np.array(self.tokenizer.encode_batch_fast([[p.decode() for p in some]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32))
            # no token goes across pieces, so a piece ends where as many bytes are through
            ends = np.searchsorted(np.cumsum(self.bytes[ids[-1]]), np.cumsum([len(p) for p in some]), "right")
            many.append(np.diff(ends, prepend=0).astype(np.int32))
        if new:
            self.ids, self.many = np.concatenate(ids), np.concatenate(many)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        buf, offs = tk.pack(texts)
        odd = rp.covered(len(offs) - 1, np.unique(np.searchsorted(offs, np.flatnonzero(FOREIGN[buf] | self._signs(buf)), "right") - 1), np.ones(1, np.int64)) if len(buf) else np.zeros(len(offs) - 1, bool)
        raw, marks, whole = buf.tobytes(), [], {}
        if odd.any():
            starts = piece_starts(buf, offs)
            keep = ~odd[np.searchsorted(offs, starts, "right") - 1]
            marks.append(starts[keep])
            for k in np.flatnonzero(odd).tolist():
                text = raw[offs[k] : offs[k + 1]].decode()
                if any(s in text for s in self.special):
                    whole[k] = np.array(self.plain(text), np.uint32)
                else:
                    sizes = np.fromiter((len(p.encode()) for p in self.pattern.findall(text)), np.int64)
                    marks.append(offs[k] + np.cumsum(sizes) - sizes)
            starts = np.sort(np.concatenate(marks))
        else:
            starts = piece_starts(buf, offs)
        of = np.searchsorted(offs, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(buf)), offs[of + 1])
        same, reps = distinct(buf, starts, ends)
        pieces = [raw[a:b] for a, b in zip(starts[reps].tolist(), ends[reps].tolist())]
        number = self.numbers(pieces)[same]
        many = self.many[number].astype(np.int64)
        first = np.cumsum(self.many, dtype=np.int64) - self.many
        out = self.ids[tk.ranges(first[number], many)]
        counts = np.bincount(of, many, len(offs) - 1).astype(np.int64)
        if whole:
            parts = np.split(out, np.cumsum(counts)[:-1])
            for k, x in whole.items():
                parts[k], counts[k] = x, len(x)
            out = np.concatenate(parts)
        return out, counts

    def _signs(self, buf: np.ndarray) -> np.ndarray:
        """Where a special token's string may begin, or a sign that is no letter stands among Latin-1 ones."""
        found = np.zeros(len(buf), bool)
        found[1:] = (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
        for s in self.special:
            head = np.frombuffer(s.encode()[:2], np.uint8)
            found[: len(buf) - len(head) + 1] |= np.logical_and.reduce([buf[k : len(buf) - len(head) + 1 + k] == x for k, x in enumerate(head)])
        return found


def bpe_pattern(path: str) -> str:
    """The pattern of a byte-level tokenizer file: its own, or the one that the library uses where a file names none."""
    with open(path, encoding="utf-8") as f:
        pre = json.load(f)["pre_tokenizer"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level tokenizers with the usual pattern")
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One for a worker, whatever tasks it runs."""
    return Pieces(path)


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span the number of its content, and for each content a span that has it; spans of one hash are compared byte by byte."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, first, run = tk.groups_of(tk.span_hash(buf, starts, ends))
    rep = order[first][run]
    at, n = tk.eights(buf), (ends - starts)[order]
    same = n == (ends - starts)[rep]
    done, live = 0, np.flatnonzero(same)
    while len(live):
        mask = tk._MASK[np.minimum(n[live] - done, 8)]
        same[live] &= (at[starts[order[live]] + done] & mask) == (at[starts[rep[live]] + done] & mask)
        done += 8
        live = live[same[live] & (n[live] > done)]
    number = np.empty(len(starts), np.int64)
    number[order] = run
    reps = order[first]
    if not same.all():  # contents that share a hash: named by their bytes
        names: dict[bytes, int] = {}
        more = []
        for i in order[~same].tolist():
            piece = buf[starts[i] : ends[i]].tobytes()
            if piece not in names:
                names[piece] = len(reps) + len(more)
                more.append(i)
            number[i] = names[piece]
        reps = np.append(reps, more)
    return number, reps


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Planes of a block, lowest first; one without a set bit is empty."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    planes = np.ascontiguousarray(octets.T) if kind == "byte" else np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    press = zstandard.ZstdCompressor(level=level).compress
    return [press(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    kind = "byte" if len(planes) == 4 else "bit"
    size = n if kind == "byte" else -(-n // 8)
    open_ = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(open_(p), np.uint8) if p else np.zeros(size, np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


CODED_SQL = "doc_id long, row long, n long, ids binary"
CODED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
BLOCKS_SQL = "part int, block int, first long, n int, sizes array<int>, crc long, planes array<binary>, docs array<long>, numbers array<long>, skipped array<long>, taken array<long>"
BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("sizes", pa.list_(pa.int32())), ("crc", pa.int64()), ("planes", pa.list_(pa.binary())), *((c, pa.list_(pa.int64())) for c in ("docs", "numbers", "skipped", "taken"))])


def encode(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (its place in the input), n and ``ids`` (little-endian, two bytes an id where the vocabulary allows)."""
    size = max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id or 0)
    width = np.dtype("<u2" if size < 1 << 16 else "<u4")

    def run(batches):
        row, known = TaskContext.get().partitionId() << 33, pieces_of(path)
        for batch in batches:
            texts = batch.column("text")
            _, offs = tk.pack(texts)
            for lo, hi in tk.slices(offs, 4 << 20):
                ids, counts = known.encode(texts.slice(lo, hi - lo))
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                ends = np.concatenate(([0], np.cumsum(counts))) * width.itemsize
                blob = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(width).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(np.arange(row, row + hi - lo)), pa.array(counts), blob], schema=CODED)
                row += hi - lo

    return rp.whole(docs, id_col, text_col).mapInArrow(run, CODED_SQL)


def _blocks(block: int, kind: str):
    """A part's documents, in order -> its blocks."""

    def run(batches):
        part, number, first, held, size, k, skip = TaskContext.get().partitionId(), 0, 0, [], 0, 0, 0
        entries: list[tuple[int | None, int, int, int]] = []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([np.zeros(0, np.uint32), *held])
            planes = to_planes(ids, kind)
            columns = [list(c) for c in zip(*entries)] or [[], [], [], []]
            return rp.rows(BLOCKS, [(part, k, first, len(ids), [len(p) for p in planes], zlib.crc32(ids.astype("<u4").tobytes()), planes, *columns)]).to_batches()[0]

        for batch in batches:
            for doc, n, blob in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                raw = blob.as_buffer()
                ids = np.frombuffer(raw, np.dtype("<u2" if raw.size == 2 * n else "<u4")).astype(np.uint32)
                skip = 0
                while True:
                    some = ids[skip : skip + block - size]
                    entries.append((doc, number, skip, len(some)))
                    held.append(some)
                    size, skip = size + len(some), skip + len(some)
                    if size == block:
                        yield closed()
                        held, entries, first, size, k = [], [], first + size, 0, k + 1
                    if skip == n:
                        break
                number += 1
        if entries:
            yield closed()

    return run


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int | None = None, kind: str = "byte", block: int = BLOCK, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents' ids in ascending order of the id column to ``folder``: blocks, and their index."""
    spark = docs.sparkSession
    with graph.Tables(docs) as tables:
        coded = tables.keep(encode(docs, path, end_id, id_col, text_col))
        total = coded.agg(F.sum("n")).first()[0] or 0
        order = [F.asc_nulls_last("doc_id"), "n", F.xxhash64("ids"), "row"]
        parts = coded.repartitionByRange(max(1, -(-total // part)), *order).sortWithinPartitions(*order)
        parts.select("doc_id", "n", "ids").mapInArrow(_blocks(block, kind), BLOCKS_SQL).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    found = spark.read.schema(BLOCKS_SQL).parquet(f"{folder}/blocks")
    starts, at = [], 0
    for p, n in found.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a part
        starts.append((p, at))
        at += n
    begin = F.broadcast(spark.createDataFrame(starts, "part int, begin long"))
    found.select("part", "block", "first", "n", "sizes", "crc").join(begin, "part").select("part", "block", (F.col("begin") + F.col("first")).alias("start"), "n", "sizes", "crc").write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, start (of its first id in the whole sequence), n, sizes (bytes of each plane), crc."""
    return spark.read.schema("part int, block int, start long, n int, sizes array<int>, crc long").parquet(f"{folder}/index")


PIECES_SQL = "part int, number long, doc_id long, at long, skipped long, n long, crc long, ids array<int>"
PIECES = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("skipped", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.list_(pa.int32()))])


def read_pieces(blocks: DataFrame, ids: bool = True) -> DataFrame:
    """What each block has of each document: part, number (of the document in it), doc_id, at (of the piece, in the part), skipped (ids of the document before it), n, crc and, if wanted, the ids.

    A block whose ids differ from its checksum is an error.
    """

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                all_ids = from_planes(b["planes"], b["n"])
                if zlib.crc32(all_ids.tobytes()) != b["crc"]:
                    raise ValueError(f"block {b['block']} of part {b['part']} is damaged")
                out, at = [], 0
                for doc, number, skipped, taken in zip(b["docs"], b["numbers"], b["skipped"], b["taken"]):
                    some = all_ids[at : at + taken]
                    out.append((b["part"], number, doc, b["first"] + at, skipped, taken, zlib.crc32(some.tobytes()), some.astype(np.int32) if ids else None))
                    at += taken
                yield from rp.rows(PIECES, out).to_batches()

    return blocks.select("part", "block", "first", "n", "crc", "planes", "docs", "numbers", "skipped", "taken").mapInArrow(run, PIECES_SQL)


def read_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """The ids at start..stop-1 of the whole sequence, by blocks (start, ids), from the blocks that have some of them only."""
    near = read_index(spark, folder).where((F.col("start") < stop) & (F.col("start") + F.col("n") > start)).select("part", "block", "start")
    blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{folder}/blocks").drop("docs", "numbers", "skipped", "taken").join(near, ["part", "block"])

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                lo = max(0, start - b["start"])
                ids = from_planes(b["planes"], b["n"])[lo : max(0, stop - b["start"])]
                yield pa.RecordBatch.from_arrays([pa.array([b["start"] + lo]), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    return blocks.select("start", "n", "planes").mapInArrow(run, "start long, ids array<int>")


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """The CRC-32 of byte strings end to end, from (crc, bytes) of each."""
    total = 0
    for crc, size in pieces:
        total = _moved(total, 8 * size) ^ crc
    return total


@lru_cache(maxsize=1024)
def _power(k: int) -> int:
    """x ** 2 ** k modulo the checksum's polynomial (bits reversed)."""
    return 0x40000000 if k == 0 else _times(_power(k - 1), _power(k - 1))


def _times(a: int, b: int) -> int:
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def _moved(crc: int, bits: int) -> int:
    """The checksum as many bits further on."""
    k = 0
    while bits and crc:
        if bits & 1:
            crc = _times(_power(k), crc)
        bits >>= 1
        k += 1
    return crc


def read_documents(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers) and, if wanted, the ids of each document, from the files."""
    blocks = spark.read.schema(BLOCKS_SQL).parquet(f"{folder}/blocks")
    begin = read_index(spark, folder).where("block = 0").select("part", F.col("start").alias("begin"))  # a row a part
    some = F.struct("skipped", "n", "crc", *["ids"] * ids)
    whole = read_pieces(blocks, ids).groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(some)).alias("pieces"))
    whole = whole.join(F.broadcast(begin), "part")

    def run(batches):
        for batch in batches:
            n, crc = (batch.column("pieces").flatten().field(c).to_numpy() for c in ("n", "crc"))
            offs = batch.column("pieces").offsets.to_numpy()
            offs = offs - offs[0]
            out = crc[offs[:-1]].copy()
            for k in np.flatnonzero(np.diff(offs) > 1).tolist():
                out[k] = joined_crc([(int(c), 4 * int(m)) for c, m in zip(crc[offs[k] : offs[k + 1]], n[offs[k] : offs[k + 1]])])
            columns = [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column("ids")] if ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    start = (F.col("begin") + F.col("at")).alias("start")
    flat = [F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("ids")] if ids else []
    return whole.select("doc_id", start, "n_tokens", "pieces", *flat).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
