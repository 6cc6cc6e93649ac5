"""Substring deduplication with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one text; each word that lies in a
window whose words also start in a document with a smaller id is removed.

The suffixes that can matter (see ``repeats``) are split among groups by
variable-length prefixes of their minimising gram: two words, or three and more
where a count over the whole corpus says that the prefix is too frequent for a
group's memory.  Each group grows its suffix tree top-down, level by level: the
suffixes under a node are split by their next word, lone suffixes are leaves and
go no further, and the nodes that are left at depth ``WINDOW`` are the repeats.

Words are compared by their bytes (numbered in a dictionary of the group);
windows of heavy minimisers by two independent 64-bit hashes.

Defined results: a null or empty text has no words; documents with equal ids
don't remove from one another, so of repeated rows each loses the same; a null id
counts as larger than all others; very long texts are handled whole, in the chunk
they were dealt to; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barproof.llm import repeats as rp
from barproof.llm import textkit as tk

U64 = np.uint64
WINDOW, GRAM = 13, 4
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
BINS = 1 << 16


def _words(buf, offs):
    starts, ends, doc = tk.word_spans(buf, offs)
    return starts, ends, doc, tk.span_hash(buf, starts, ends)


class WordTrees:
    """Windows of words, compared in suffix trees."""

    sql = SQL

    def __init__(self, window: int = WINDOW, group_bytes: int = 4 << 20, texts: bool = False):
        self.window, self.gram, self.group_bytes, self.texts = window, min(GRAM, window), group_bytes, texts
        self.width = self.window - self.gram + 1
        if not texts:
            self.sql = SQL.replace(", kept_text string", "")

    def ready(self, docs: DataFrame, n: int) -> None:
        """Choose the prefixes: a count of two-word prefixes (65,536 sums, whatever the corpus) sets the groups."""
        self.places = n
        bins = docs.select("id", "text").mapInArrow(self._prefix_counts, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
        count = np.zeros(BINS, np.int64)
        for r in bins:
            count[r.bin] = r.n
        limit = max(1, int(count.sum()) // n)
        self.parts = np.maximum(-(-count // limit), 1).astype(np.int64)
        light = np.where(self.parts > 1, 0, count)
        # light prefixes next to one another share a group; a heavy one has groups of its own
        group, filled, out = 0, 0, np.zeros(BINS, np.int64)
        for b in np.flatnonzero(count):
            if self.parts[b] > 1 or filled + light[b] > limit:
                group, filled = group + (filled > 0), 0
            out[b] = group
            if self.parts[b] > 1:
                group += int(self.parts[b])
            filled += light[b]
        self.first = out

    @staticmethod
    def _prefix_counts(batches):
        count = np.zeros(BINS, np.int64)
        for batch in batches:
            buf, offs = tk.pack(batch.column("text"))
            for lo, hi in tk.slices(offs):
                *_, doc, h = _words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                if len(h) > 1:
                    count += np.bincount(((h[:-1] >> U64(56)) << U64(8) | h[1:] >> U64(56)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["bin", "n"])

    def _order(self, h: np.ndarray) -> np.ndarray:
        """Of each gram, a hash from which the prefix can be had again: three words' bytes, then the gram."""
        n = len(h) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        head = h[:n] >> U64(56) << U64(56)
        for i in range(1, min(3, self.gram)):
            head |= h[i : i + n] >> U64(56) << U64(56 - 8 * i)
        return tk.mix(head | tk.gram_hash(h, self.gram) >> U64(24))

    def _place(self, marks: np.ndarray) -> np.ndarray:
        key = tk.unmix(marks)
        two = (key >> U64(48)).astype(np.int64)
        # a heavy prefix goes on with the third word and the rest of the gram, as finely as it must
        more = ((key >> U64(16)) & U64(0xFFFFFFFF)).astype(np.int64)
        return self.first[two] + (more * self.parts[two] >> 32)

    def _windows(self, doc, h):
        n = len(h) - self.window + 1
        if n <= 0:
            return (z := np.zeros(0, np.uint64)), z, z.astype(bool)
        order = self._order(h)
        return order, tk.sliding(order, self.width), doc[:n] == doc[self.window - 1 :]

    def marks(self, buf, offs):
        *_, doc, h = _words(buf, offs)
        order, least, valid = self._windows(doc, h)
        return order[rp.chosen(order, least, valid, self.width)] if len(least) else least

    def leaves(self, chunk, buf, offs, ids, known, heavy):
        starts, ends, doc, h = _words(buf, offs)
        _, least, valid = self._windows(doc, h)
        if not len(least):
            return []
        at = np.flatnonzero(valid & rp.known_marks(least, known))
        if not len(at):
            return []
        row, mark = doc[at], least[at]
        base = np.searchsorted(doc, np.arange(len(offs) - 1))
        a = rp.runs_of(mark, row, at - np.arange(len(at)))
        count = np.diff(np.append(a, len(at)))
        at, row, mark = at[a], row[a], mark[a]
        pos, own, hot, out = at - base[row], ids[row], heavy[np.searchsorted(known, mark)], []
        if hot.any():
            out.append(self._single(chunk, h, at[hot], row[hot], pos[hot], count[hot], own[hot]))
        at, row, mark, pos, count, own = (x[~hot] for x in (at, row, mark, pos, count, own))
        raw = buf.tobytes()
        text = [raw[x:y] for x, y in zip(starts[at].tolist(), ends[at + count + self.window - 2].tolist())]
        lead = rp.first_of_each(text)
        low = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(low, lead, own)
        gone = own > low[lead]  # a leaf of the same text stands in a text of smaller id
        out.append(rp.leaf_table(1, chunk, chunk, row[gone], pos[gone], count[gone], 0, 0, 0))
        keep = np.flatnonzero(~gone)
        out.append(rp.leaf_table(0, chunk, self._place(mark[keep]), row[keep], pos[keep], count[keep], mark[keep], 0, own[keep], [text[i] for i in keep.tolist()]))
        return out

    def _single(self, chunk, h, at, row, pos, count, own):
        """Windows of heavy minimisers; those that repeat within the chunk leave it once."""
        each = tk.ranges(at, count)
        row, pos, own = np.repeat(row, count), tk.ranges(pos, count), np.repeat(own, count)
        one, two = tk.gram_hash(h, self.window)[each], tk.gram_hash(tk.mix(h ^ tk._STEP), self.window)[each]
        order, first, run = rp.same_twice(one, two)
        low = np.empty(len(order), np.int64)
        low[order] = np.minimum.reduceat(own[order], first)[run]
        gone = own > low
        r, p = row[gone], pos[gone]
        a = rp.runs_of(r, p - np.arange(len(p)))
        done = rp.leaf_table(1, chunk, chunk, r[a], p[a], np.diff(np.append(a, len(p))), 0, 0, 0)
        k = ~gone
        return pa.concat_tables([done, rp.leaf_table(2, chunk, (one[k] % U64(self.places)).astype(np.int64), row[k], pos[k], 1, one[k], two[k], own[k])])

    def equal(self, one, two, ids):
        """Which of one place's windows of heavy minimisers are also in a text of smaller id."""
        order, first, run = rp.same_twice(one, two)
        low = np.empty(len(one), np.int64)
        low[order] = np.minimum.reduceat(ids[order], first)[run]
        return ids > low

    def repeats(self, leaves):
        """(leaf, first position, number of windows) of the runs of windows that also stand in a text of smaller id."""
        pos, count, ids = (rp.column(leaves, c).astype(np.int64) for c in ("pos", "n", "extra"))
        words, number = b" ".join(leaves.column("text").to_pylist()).split(), {}
        word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))  # words by their bytes, not by a hash
        size = count + self.window - 1
        base = np.cumsum(size) - size
        which = np.repeat(np.arange(len(count)), count)
        step = tk.ranges(np.zeros(len(count), np.int64), count)
        suffix = base[which] + step
        # the tree, a level at a time: node of each suffix that isn't alone under its node
        node, live, width = np.zeros(len(suffix), np.int64), np.arange(len(suffix)), len(number)
        for depth in range(self.window):
            order, first, run = tk.groups_of(node * width + word[suffix[live] + depth])
            inner = (np.diff(np.append(first, len(live))) > 1)[run]
            live, node = live[order[inner]], run[inner]
            if not len(live):
                return live, live, live
        order, first, run = tk.groups_of(node)
        own = ids[which[live[order]]]
        gone = np.sort(live[order][own > np.minimum.reduceat(own, first)[run]])
        leaf, p = which[gone], pos[which[gone]] + step[gone]
        a = rp.runs_of(leaf, p - np.arange(len(p)))
        return leaf[a], p[a], np.diff(np.append(a, len(p)))

    def report(self, doc_ids, buf, offs, row, pos, many):
        starts, _, doc, = tk.word_spans(buf, offs)
        base = np.searchsorted(doc, np.arange(len(offs)))
        gone = rp.covered(len(doc), base[row] + pos, many + self.window - 1)
        n_gone = np.add.reduceat(np.append(gone, False), base[:-1]) if len(base) > 1 else np.zeros(0)
        n_words = np.diff(base)
        data, shas, kept_texts = buf.tobytes(), [], []
        for i in range(len(offs) - 1):
            words = data[offs[i] : offs[i + 1]].split()
            kept = b" ".join(compress(words, ~gone[base[i] : base[i + 1]]) if n_words[i] and n_gone[i] else words)
            shas.append(hashlib.sha256(kept).hexdigest())
            if self.texts:
                kept_texts.append(kept.decode())
        columns = [doc_ids, pa.array(n_words, pa.int64()), pa.array(np.where(n_words > 0, n_gone, 0), pa.int64()), pa.array(shas)]
        return pa.table([*columns, pa.array(kept_texts)] if self.texts else columns, names=SCHEMA.names[: 4 + self.texts])


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = 4 << 20, texts: bool = True, heavy: int = rp.HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text of each document."""
    kit = WordTrees(window, texts=texts)
    schema = SCHEMA if texts else pa.schema(list(SCHEMA)[:4])
    return rp.remove_repeats(rp.whole(docs, id_col, text_col), kit, schema, chunk_bytes, heavy)
