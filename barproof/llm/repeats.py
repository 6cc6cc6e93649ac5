"""Exact removal of passages that recur across a corpus, without shipping every position.

Shared skeleton of the substring deduplication (words) and the suffix-array
deduplication (bytes).  Windows of a fixed length are compared over all texts:

1. Texts are dealt by a hash of id and text into chunks of bounded size.  The same
   exchange feeds steps 2, 3 and 5, so texts move once.
2. *Marks.*  Each window has a minimiser, the least hash of its short grams.
   Equal windows have equal minimisers, so a window can only recur if its
   minimiser does.  Each chunk sends its distinct minimisers (one for several
   windows) and how often it holds each; what stands more than once is sent
   back, with a flag if it does more than ``HEAVY`` times.
3. *Leaves.*  Runs of windows with one minimiser travel together, as text, to the
   place of their minimiser; leaves of one text leave a chunk once (compared as
   text), so a passage that stands in a third of all texts leaves each chunk
   once.  Windows of a heavy minimiser (a short passage that many texts have in
   different surroundings) travel one by one, as two independent 64-bit hashes,
   to the place of these: equal ones still meet, and no place gets all of them.
4. *Groups.*  Each memory-sized group compares its windows (suffix tree or
   suffix array) and sends back those that are repeats.
5. Each chunk marks what the repeated windows cover and reports each text.

Every message is a plain row that Spark's own exchange deals out: rows grow with
the texts, not with chunks times places.  No step gathers more than one bounded
group: marks of a very frequent passage, and its windows, number one for each
chunk; a minimiser has at most ``HEAVY`` leaves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barproof.llm import textkit as tk

U64 = np.uint64
#: Occurrences, in all texts, beyond which a minimiser's windows are dealt by their own hashes.
HEAVY = 5000


def whole(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns, under fixed names: extra columns can't clash."""
    return df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))


def places_of(docs: DataFrame, chunk_bytes: int) -> int:
    """Into how many chunks the texts are dealt."""
    return max(1, math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / chunk_bytes))


def dealt(docs: DataFrame, n: int) -> DataFrame:
    """Rows with their chunk; the text decides with the id, so rows without an id, or with one id, are spread too."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a chunk in an order that doesn't depend on how they arrived (null ids last)."""
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")]))


def ids_of(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("id"), np.iinfo(np.int64).max).to_numpy().astype(np.int64)


def rows(schema: pa.Schema, data: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), t.type) for c, t in zip(zip(*data), schema)] if data else [pa.array([], t.type) for t in schema], schema=schema)


def gathered(batches, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


MARKS = pa.schema([("mark", pa.int64()), ("chunk", pa.int32()), ("often", pa.int32())])
MARKS_SQL = "mark long, chunk int, often int"
KNOWN = pa.schema([("chunk", pa.int32()), ("mark", pa.int64()), ("heavy", pa.bool_())])
KNOWN_SQL = "chunk int, mark long, heavy boolean"
#: kind 0: leaves of n windows; 1: windows that are repeats already; 2: windows of heavy minimisers, as two hashes (mark, other)
LEAVES = pa.schema([("place", pa.int64()), ("chunk", pa.int32()), ("kind", pa.int32()), ("row", pa.int32()), ("pos", pa.int32()), ("n", pa.int32()), ("mark", pa.int64()), ("other", pa.int64()), ("extra", pa.int64()), ("text", pa.binary())])
LEAVES_SQL = "place long, chunk int, kind int, row int, pos int, n int, mark long, other long, extra long, text binary"
HITS = pa.schema([("chunk", pa.int32()), ("row", pa.int32()), ("pos", pa.int32()), ("n", pa.int32())])
HITS_SQL = "chunk int, row int, pos int, n int"


def marks_of(chunk: int, marks: np.ndarray) -> pa.Table:
    """A chunk's distinct marks, and how often it has each."""
    m = np.sort(marks)
    first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1]))) if len(m) else np.zeros(0, int)
    often = np.diff(np.append(first, len(m))).astype(np.int32)
    return pa.table([m[first].view(np.int64), np.full(len(first), chunk, np.int32), often], schema=MARKS)


def repeated_marks(batches, heavy: int = HEAVY):
    """Of one partition's marks, those that stand more than once, for each chunk that has them, and whether they stand over ``heavy`` times."""
    table = gathered(batches, MARKS)
    if not table.num_rows:
        return
    order, first, run = tk.groups_of(column(table, "mark"))
    total = np.add.reduceat(column(table, "often")[order].astype(np.int64), first)[run]
    keep = total > 1
    at = order[keep]
    yield from pa.table([column(table, "chunk")[at], column(table, "mark")[at], total[keep] > heavy], schema=KNOWN).to_batches()


def known_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Repeated marks of a chunk, sorted, and which of them are heavy."""
    known = column(table, "mark").view(np.uint64) if table.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(known)
    return known[order], (table.column("heavy").to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool))[order]


def leaf_table(kind: int, chunk: int, place, row, pos, n, mark, other, extra, text=None) -> pa.Table:
    size = len(row)
    filled = lambda x, t: np.full(size, x, t) if np.isscalar(x) else np.ascontiguousarray(x).astype(t)
    word = lambda x: filled(x, np.int64) if np.isscalar(x) else x.view(np.int64)
    columns = [filled(place, np.int64), filled(chunk, np.int32), filled(kind, np.int32), filled(row, np.int32), filled(pos, np.int32), filled(n, np.int32), word(mark), word(other), filled(extra, np.int64)]
    return pa.table([*columns, pa.nulls(size, pa.binary()) if text is None else pa.array(text, pa.binary())], schema=LEAVES)


def remove_repeats(docs: DataFrame, kit, schema: pa.Schema, chunk_bytes: int, heavy: int = HEAVY) -> DataFrame:
    """``docs`` has id and text (see ``whole``).  ``kit`` knows windows, marks, groups and results."""
    n = places_of(docs, chunk_bytes)
    kit.ready(docs, n)

    def mark(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        buf, offs = tk.pack(table.column("text"))
        return marks_of(key[0].as_py(), np.concatenate([kit.marks(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in tk.slices(offs)]))

    def leaves(key: tuple[pa.Scalar, ...], table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows or not marks.num_rows:
            return LEAVES.empty_table()
        table = in_order(table)
        return pa.concat_tables([LEAVES.empty_table(), *kit.leaves(key[0].as_py(), *tk.pack(table.column("text")), ids_of(table), *known_of(marks))])

    def group(table: pa.Table) -> pa.Table:
        kind = column(table, "kind")
        of = lambda k: table.filter(pa.array(kind == k))
        done = of(1)
        out = [done.select(HITS.names)]
        if (some := of(0)).num_rows:
            leaf, pos, many = kit.repeats(some)
            out.append(pa.table([column(some, "chunk")[leaf], column(some, "row")[leaf], pos.astype(np.int32), many.astype(np.int32)], schema=HITS))
        if (some := of(2)).num_rows:
            out.append(some.filter(pa.array(kit.equal(column(some, "mark"), column(some, "other"), column(some, "extra")))).select(HITS.names))
        return pa.concat_tables([x.cast(HITS) for x in out])

    def report(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        table = in_order(table)
        row, pos, many = (column(hits, c).astype(np.int64) if hits.num_rows else np.zeros(0, np.int64) for c in ("row", "pos", "n"))
        return kit.report(table.column("id"), *tk.pack(table.column("text")), row, pos, many)

    by = dealt(docs, n).groupBy("chunk")
    known = by.applyInArrow(mark, MARKS_SQL).repartition(n, "mark").mapInArrow(lambda b: repeated_marks(b, heavy), KNOWN_SQL)
    sent = by.cogroup(known.groupBy("chunk")).applyInArrow(leaves, LEAVES_SQL)
    hits = sent.groupBy("place").applyInArrow(group, HITS_SQL)
    return by.cogroup(hits.groupBy("chunk")).applyInArrow(report, kit.sql)


def same_twice(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``groups_of``, by two hashes."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(first), np.cumsum(first) - 1


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal neighbours begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def known_marks(marks: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(marks), bool)
    at = np.searchsorted(known, marks)
    at[at == len(known)] = 0
    return known[at] == marks


def chosen(order: np.ndarray, least: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Which grams are the minimiser of some valid window."""
    edge = np.zeros(width - 1, np.uint64)
    most = tk.sliding(np.concatenate((edge, np.where(valid, least, U64(0)), edge)), width, np.maximum)
    return (most == order) & (most > 0)


def first_of_each(texts: list) -> np.ndarray:
    """For each entry, the number of the first equal one."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(t, i) for i, t in enumerate(texts)), np.int64, len(texts))


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of n units, which lie in one of these spans."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0
