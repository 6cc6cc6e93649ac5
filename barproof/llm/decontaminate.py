"""Benchmark decontamination with a generalised suffix automaton.

All items' words form one suffix automaton (generalised: it restarts for each
item).  Texts stream through it; at each word it knows the longest match that
ends there.  A match of ``window`` words or more is an occurrence of an item's
window; an item shorter than that (but with words) is one window as a whole.

The automaton is broadcast, and its size is checked first: items of more than
``most_bytes`` are cut into slices of about that size, each collected, built and
sent on its own.  A slice of b bytes has at most b states and 1.5 b transitions
(words are two bytes with their space, and an automaton of n words has at most 2n
states and 3n transitions), kept in one table.  ``slices_a_pass`` slices (a bound
of a worker's memory) go through the texts together.  Where that isn't all, a
pass writes what it hits only: spans and items of the texts that have any, one
row for equal texts; the last pass joins them.  Texts are read once a pass, and
move only where ``kept_text`` is asked for.  An item's windows never depend on
other items, so slicing changes no result.

Defined results: null or empty texts have no words and aren't contaminated;
items without words match nothing; a null item id counts no item but its words
are hit; repeated item ids count once; repeated documents give one row each; very
long texts are read whole; without items nothing is hit; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barproof.llm import graph
from barproof.llm import repeats as rp

WINDOW = 13
#: Word bytes stay (A-Z in lower case); all others become spaces.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SQL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        said = [(i, [self.ids.setdefault(w, len(self.ids)) for w in words_of(t)]) for i, t in items]
        for _, seq in said:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        # the state that holds a match's last `window` words, and which items have them
        self.at_window = [self._up(s) for s in range(len(self.link))]
        self.items: dict[int, set[str]] = {}
        short: dict[int, set[tuple[int, str | None]]] = {}
        for item, seq in said:
            if len(seq) >= window:
                for _, state, length in self.matches(seq):
                    if length >= window and item is not None:
                        self.items.setdefault(self.at_window[state], set()).add(item)
            elif seq:
                *_, (_, state, _) = self.matches(seq)
                short.setdefault(state, set()).add((len(seq), item))
        # whole short items that end wherever a state's match ends
        self.short: list[tuple] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = tuple(short.get(s, ()))
            self.short[s] = self.short[self.link[s]] + own if own else self.short[self.link[s]]
        self.any_short = bool(short)
        self.step = {s << 32 | w: t for s, own in enumerate(self.next) for w, t in own.items()}
        self.next = []

    def _up(self, s: int) -> int:
        if self.length[s] < self.window:
            return -1
        while self.link[s] >= 0 and self.length[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def matches(self, seq):
        """(position, state, longest match length) at each word; ids are None for unknown words."""
        step, link, length = self.next, self.link, self.length
        s = n = 0
        for i, w in enumerate(seq):
            t = step[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = step[s].get(w)
            if t is None:
                n = 0
            else:
                s = t
                n += 1
            yield i, s, n

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [from, to) of words in occurring windows, and the items that have them."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        step, link, length, window, short = self.step, self.link, self.length, self.window, self.short
        look = min(window, 1) if self.any_short else window
        s = n = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                s = n = 0
                continue
            t = step.get(s << 32 | w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = step.get(s << 32 | w)
            if t is None:
                n = 0
                continue
            s = t
            n += 1
            if n < look:
                continue
            size = 0
            if n >= window:
                size = window
                items |= self.items.get(self.at_window[s], set())
            for k, item in short[s]:
                if k <= n:
                    size = max(size, k)
                    if item is not None:
                        items.add(item)
            if size:
                a = i + 1 - size
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, items


def _slices(items: DataFrame, id_col: str, text_col: str, most_bytes: int) -> tuple[DataFrame, int]:
    """Distinct items with the number of their slice, and the number of slices."""
    own = items.select(items[id_col].cast("string").alias("id"), items[text_col].cast("string").alias("text")).distinct()
    size = own.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)) + 16)).first()[0] or 0
    n = math.ceil(size / most_bytes) or 1
    return own.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = 0.05, most_bytes: int = 2 << 20, slices_a_pass: int = 4, full: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (coverage reached); with ``full`` also
    ``items``, ``spans`` (word positions) and ``kept_text`` (the words outside all spans)."""
    spark = docs.sparkSession
    graph.shared_folder(docs)
    cut, n_slices = _slices(items, item_id_col, item_text_col, most_bytes)
    cut = graph.left_over(cut) if n_slices > 1 else cut
    df = rp.whole(docs, id_col, text_col).withColumn("key", F.sha2("text", 256) if n_slices > slices_a_pass else F.lit(None).cast("string"))
    out_sql = SQL + (", items array<string>, spans array<struct<a:int,b:int>>, kept_text string" if full else "")
    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())] + [("items", pa.list_(pa.string())), ("spans", span_type), ("kept_text", pa.string())] * full)
    hits_sql = "key string, spans array<struct<a:int,b:int>>, items array<string>"
    hits_schema = pa.schema([("key", pa.string()), ("spans", span_type), ("items", pa.list_(pa.string()))])
    part_sql = f"id long, n_words long, text string, {hits_sql}"
    part_schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()), *hits_schema])
    limit = round(coverage * 10_000)
    pairs = lambda spans: [{"a": a, "b": b} for a, b in spans]

    def report(doc: int | None, words: list[bytes] | None, n_words: int, found: list[tuple[int, int]], own: set[str]) -> tuple:
        listed, hit = sorted(own), sum(b - a for a, b in found)
        row = (doc, n_words, hit, len(own), hashlib.sha256(",".join(listed).encode()).hexdigest(), hit > 0 and 10_000 * hit >= limit * n_words)
        if not full:
            return row
        kept, at = [], 0
        for a, b in found:
            kept += words[at:a]
            at = b
        return *row, listed, pairs(found), b" ".join(kept + words[at:]).decode()

    def one_pass(sent: list, kind: str):
        """``whole``: results; ``hits``: texts that are hit; ``part``: each text's hits of this pass, for a join with those of the others."""

        def run(batches):
            machines = [x.value for x in sent]
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part, out = batch.slice(lo, 512), []
                    for doc, text, key in zip(*(part.column(c).to_pylist() for c in ("id", "text", "key"))):
                        words = words_of(text)
                        found, own = machines[0].hits(words)
                        for machine in machines[1:]:
                            more, named = machine.hits(words)
                            found, own = merged(found + more), own | named
                        if kind == "whole":
                            out.append(report(doc, words, len(words), found, own))
                        elif kind == "part":
                            out.append((doc, len(words), text if full else None, key, pairs(found), list(own)))
                        elif found:
                            out.append((key, pairs(found), list(own)))
                    yield from rp.rows({"whole": out_schema, "hits": hits_schema, "part": part_schema}[kind], out).to_batches()

        return run

    def together(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = []
                for r in batch.slice(lo, 512).to_pylist():
                    every = [r, *(r["before"] or ())]
                    found = merged([(x["a"], x["b"]) for h in every for x in h["spans"]])
                    out.append(report(r["id"], words_of(r["text"]) if full else None, r["n_words"], found, {i for h in every for i in h["items"]}))
                yield from rp.rows(out_schema, out).to_batches()

    before = None
    for k in range(0, n_slices, slices_a_pass):
        own = range(k, min(k + slices_a_pass, n_slices))
        # each slice has about most_bytes
        sent = [spark.sparkContext.broadcast(Automaton([(r.id, r.text) for r in cut.where(F.col("slice") == j).collect()], window)) for j in own]
        if n_slices <= slices_a_pass:
            return df.mapInArrow(one_pass(sent, "whole"), out_sql)
        if own[-1] < n_slices - 1:
            # equal texts have equal hits, of which one row stays
            hits = graph.left_over(df.mapInArrow(one_pass(sent, "hits"), hits_sql).dropDuplicates(["key"]))
            before = hits if before is None else before.unionByName(hits)
            for x in sent:
                x.destroy()
    # a text has at most one row for each earlier pass
    before = before.groupBy("key").agg(F.collect_list(F.struct("spans", "items")).alias("before"))
    return df.mapInArrow(one_pass(sent, "part"), part_sql).join(before, "key", "left").drop("key").mapInArrow(together, out_sql)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
