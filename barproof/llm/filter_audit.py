"""How the filters of a corpus interact: what each removes, in every order they can be applied.

Filters are conditions under which a text fails, one letter each, as column
expressions; one more letter stands for exact copies.  A copy is a text that some
smaller doc_id of the whole table has too, whatever other filters do with it.

1. *Sort.*  Rows are range-sorted by text fingerprint, full text and doc_id.  Ranges
   are cut by fingerprint, doc_id and row, never by text, so bounds stay small and
   copies of one text, which may be a third of all rows, are cut too.
2. *Compare.*  Each range compares neighbours, byte by byte, and remembers for its
   last fingerprint the least id of each text.  Rows of a range's first fingerprint
   may have copies in ranges before; what those remember (one row a range) is
   summed up along the ranges and handed to them.
3. *Count.*  What is left of a row is its failure mask.  Equal (id, part, mask) rows
   are counted before they meet the labels, and counters of (part, mask, label) are
   added up: from 32 masks a part every figure of every order follows.

Defined results: a null text is empty; a null part is the empty string; a null id
is larger than every id and no smaller than another null id; repeated rows count
each, and with one id none is a copy of another; a document is good or toxic if any
label row of its id says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barproof.llm import graph

Condition = Callable[[Column], Column]
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


#: Letter -> condition under which a text fails.
FILTERS: dict[str, Condition] = {
    "A": lambda text: F.size(words(text)) < 200,
    "B": lambda text: 100 * F.size(F.array_distinct(words(text))) < 50 * F.size(words(text)),
    "C": lambda text: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
    "D": lambda text: text.rlike(r"[#$%&*|]"),
}
COPIES = "E"

SQL = "doc_id long, part string, mask int, place int, fp long, digest string, least long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("place", pa.int32()), ("fp", pa.int64()), ("digest", pa.string()), ("least", pa.int64())])


def named(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), SCHEMA)] if rows else [pa.array([], t.type) for t in SCHEMA], schema=SCHEMA)


def _compared(bit: int):
    """One range in its order -> its rows with the copies among them; ``place`` is set where ranges before may have copies too, and in rows without a mask, which say what the last fingerprint's texts have."""

    def run(batches):
        place, first_fp, fp, text = TaskContext.get().partitionId(), None, None, None
        seen = digest = None  # of the current text: the least id, and its name if ranges before may have it
        least: dict[str, int] = {}  # of the texts of the current fingerprint
        for batch in batches:
            out = []
            for own_fp, own_text, doc, part, mask in zip(*(batch.column(c).to_pylist() for c in ("fp", "text", "doc_id", "part", "mask"))):
                if own_fp != fp:
                    first_fp = own_fp if first_fp is None else first_fp
                    fp, text, least = own_fp, None, {}
                if own_text != text:
                    text, seen = own_text, doc
                    digest = named(text) if fp == first_fp else None
                    if doc is not None:
                        least[text] = doc
                elif seen is not None and (doc is None or doc > seen):
                    mask |= bit
                out.append((doc, part, mask, *((place, fp, digest) if digest else (None, None, None)), None))
            yield packed(out)
        yield packed([(None, None, None, place, fp, named(t), i) for t, i in least.items()])

    return run


def failures(docs: DataFrame, filters: dict[str, Condition] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and ``mask`` of each row: bit k for the k-th filter, the last one for copies."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("fp", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    by_id = F.asc_nulls_last("doc_id")
    in_order = base.repartitionByRange("fp", by_id, "row").sortWithinPartitions("fp", "text", by_id)
    fails = [F.when(condition(F.col("text")), 1 << k).otherwise(0) for k, condition in enumerate(filters.values())]
    mask = fails[0]
    for x in fails[1:]:
        mask = mask + x
    bit = 1 << len(filters)
    found = graph.left_over(in_order.select("fp", "text", "doc_id", "part", mask.cast("int").alias("mask")).mapInArrow(_compared(bit), SQL))
    # one row a range and text of its last fingerprint, and the ranges that ask: as many as ranges
    said = found.where("mask IS NULL").groupBy("fp", "digest", "place").agg(F.min("least").alias("least"))
    asks = found.where("mask IS NOT NULL AND place IS NOT NULL").groupBy("fp", "digest", "place").agg(F.lit(None).cast("long").alias("least"))
    before = Window.partitionBy("fp", "digest").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    line = said.unionByName(asks).withColumn("before", F.min("least").over(before)).where("before IS NOT NULL").groupBy("digest", "place").agg(F.min("before").alias("before"))
    out = found.where("mask IS NOT NULL").join(F.broadcast(line), ["digest", "place"], "left")
    copy = F.col("before").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("before")))
    return out.select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(bit))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic -> n, from rows of ``failures``."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    few = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))  # one id, or none, is a few rows now
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    return few.join(known, "doc_id", "left").select("part", "mask", *zero, "n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def report(counts: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters and step in it, for each part.

    kept after the step; removed here; redundant: failing here but removed before;
    unique_fails: failing this filter only; good_lost and toxic_lost: labelled so
    and removed here; shapley: removed by the step's filter, summed over all orders.
    """
    steps, orders = [], list(permutations(range(len(letters))))
    for order in orders:
        before = 0
        for step, k in enumerate(order):
            steps.append({"filter_order": "".join(letters[x] for x in order), "step": step + 1, "before": before, "own": 1 << k})
            before |= 1 << k
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))  # at most four rows a mask
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, before: int, own: int>>")
    rows = rows.withColumn("s", F.explode(every)).select("part", "counts", "s.*").select("*", F.explode("counts").alias("c"))
    fails, was = F.col("c.mask").bitwiseAND(F.col("own")) > 0, F.col("c.mask").bitwiseAND(F.col("before")) > 0
    here = fails & ~was
    count = lambda when, n=F.col("c.n"): F.sum(F.when(when, n).otherwise(0)).cast("long")
    # a text that fails k filters is removed by each of them in one of k orders
    share = F.col("c.n") * F.floor(F.lit(len(orders)) / F.greatest(F.bit_count(F.col("c.mask")), F.lit(1)))
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~was).alias("kept"), count(here).alias("removed"), count(fails & was).alias("redundant"), count(F.col("c.mask") == F.col("own")).alias("unique_fails"),
        count(here & (F.col("c.good") == 1)).alias("good_lost"), count(here & (F.col("c.toxic") == 1)).alias("toxic_lost"), count(fails, share).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Condition] = FILTERS) -> DataFrame:
    """The report of all filters and of copies on documents with labels (doc_id, quality, toxic)."""
    counts = graph.left_over(counters(failures(docs, filters), labels))
    return report(counts, "".join(filters) + COPIES)
