"""Suffix-array deduplication of byte passages.

Each byte that lies in a ``WINDOW``-byte string that also starts anywhere else
(same text included) is removed.  Windows meet by minimiser (see ``repeats``);
only those travel whose least grams, in two orders, both recur.  There, leaves that agree on neither half a window to the left nor one to the
right of the minimiser can't have a window in common; what is left falls into
parts, each part's suffixes are ordered by prefix doubling (``suffix_array``),
and windows that recur stand beside an equal one in that order, which is tested
byte by byte.

Defined results: null and empty texts have no bytes and lose none; repeated rows
are copies of each other and lose all windows; a null id stays null; ties don't
matter (every occurrence is removed); very long texts are handled in chunks of
their own; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barproof.llm import repeats as rp
from barproof.llm import textkit as tk
from barproof.llm.suffix_array import suffix_arrays

U64 = np.uint64
WINDOW, GRAM = 400, 32
#: Bytes of leaves, at most, that are sorted at once (one part is never cut).
BATCH = 1 << 18
#: Bytes of texts of which windows are taken at once, so that their hashes stay in a core's cache (one text is never cut).
SLICE = 1 << 16
FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("kept_text", pa.string())]
SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string"


class ByteArrays:
    """Windows of bytes, compared in suffix arrays."""

    def __init__(self, window: int = WINDOW, texts: bool = False):
        self.window, self.gram, self.texts = window, min(GRAM, window), texts
        self.width = self.window - self.gram + 1
        self.sql = SQL if texts else SQL.replace(", kept binary, kept_text string", "")

    def ready(self, docs: DataFrame, n: int) -> None:
        self.places = n

    def _windows(self, buf, offs):
        """Hashes of all grams, the least of each window in two orders (the second turns the first round), and which windows lie in one text."""
        n = len(buf) - self.window + 1
        if n <= 0:
            return (z := np.zeros(0, np.uint64)), z, z, z.astype(bool)
        order = tk.byte_grams(buf, self.gram)
        left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))
        return order, tk.sliding(order, self.width), tk.sliding(~order, self.width), left[:n] >= self.window

    def marks(self, buf, offs):
        """A window recurs only if its least gram does in both orders."""
        found = [np.zeros(0, U64)]
        for lo, hi in tk.slices(offs, SLICE):
            order, least, other, valid = self._windows(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            if len(least):
                found += order[rp.chosen(order, least, valid, self.width)], (~order)[rp.chosen(~order, other, valid, self.width)]
        return np.concatenate(found)

    def leaves(self, chunk, buf, offs, ids, known, heavy):
        parts = []
        for lo, hi in tk.slices(offs, SLICE):
            _, least, other, valid = self._windows(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            if len(least):
                at = np.flatnonzero(valid & rp.known_marks(least, known))
                at = at[rp.known_marks(other[at], known)]
                parts.append((at + offs[lo], least[at]))
        at, mark = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        if not len(at):
            return []
        row = np.searchsorted(offs, at, "right") - 1
        a = rp.runs_of(mark, row, at - np.arange(len(at)))
        count = np.diff(np.append(a, len(at)))
        at, row, mark = at[a], row[a], mark[a]
        pos, hot, out = at - offs[row], heavy[np.searchsorted(known, mark)], []
        for some in (h for h in np.array_split(np.flatnonzero(hot), -(-int(hot.sum()) // 1024) or 1) if len(h)):
            out.append(self._single(chunk, buf, at[some], row[some], pos[some], count[some]))
        at, row, mark, pos, count = (x[~hot] for x in (at, row, mark, pos, count))
        raw = buf.tobytes()
        text = [raw[x:y] for x, y in zip(at.tolist(), (at + count + self.window - 1).tolist())]
        lead = rp.first_of_each(text)
        copies = np.bincount(lead, minlength=len(lead))[lead] > 1  # leaves of one text repeat each other
        out.append(rp.leaf_table(1, chunk, chunk, row[copies], pos[copies], count[copies], 0, 0, 0))
        own = np.flatnonzero(lead == np.arange(len(lead)))
        place = (mark[own] % U64(self.places)).astype(np.int64)
        out.append(rp.leaf_table(0, chunk, place, row[own], pos[own], count[own], mark[own], 0, copies[own], [text[i] for i in own.tolist()]))
        return out

    def _single(self, chunk, buf, at, row, pos, count):
        """Windows of heavy minimisers; those that repeat within the chunk leave it once."""
        lengths = count + self.window - 1
        joined = tk.gather(buf, at, lengths)
        begin = tk.ranges(np.cumsum(lengths) - lengths, count)
        one, two = (tk.window_hash(joined, self.window, seed)[begin] for seed in (1, 2))
        row, pos = np.repeat(row, count), tk.ranges(pos, count)
        order, first, run = rp.same_twice(one, two)
        many, lead = np.empty(len(order), bool), np.zeros(len(order), bool)
        many[order] = (np.diff(np.append(first, len(order))) > 1)[run]
        lead[order[first]] = True
        r, p = row[many], pos[many]
        a = rp.runs_of(r, p - np.arange(len(p)))
        done = rp.leaf_table(1, chunk, chunk, r[a], p[a], np.diff(np.append(a, len(p))), 0, 0, 0)
        place = (one[lead] % U64(self.places)).astype(np.int64)
        return pa.concat_tables([done, rp.leaf_table(2, chunk, place, row[lead], pos[lead], 1, one[lead], two[lead], many[lead])])

    def equal(self, one, two, done):
        """Which of one place's windows of heavy minimisers recur and aren't marked yet."""
        order, first, run = rp.same_twice(one, two)
        again = np.empty(len(one), bool)
        again[order] = (np.diff(np.append(first, len(one))) > 1)[run]
        return again & (done == 0)

    def repeats(self, leaves):
        """(leaf, first position, number of windows) of the runs of windows that recur.  Leaves of one text are copies of
        each other, so all their windows recur; of different texts, windows are compared in suffix arrays."""
        pos, count, done, mark = (rp.column(leaves, c) for c in ("pos", "n", "extra", "mark"))
        texts = leaves.column("text").to_pylist()
        same = rp.first_of_each(texts)
        copies = np.bincount(same, minlength=len(same))
        first = np.flatnonzero(same == np.arange(len(same)))
        at = np.zeros(len(same) + 1, np.int64)
        windows = np.where(same == np.arange(len(same)), count, 0).astype(np.int64)
        at[1:] = np.cumsum(windows)
        again = np.repeat(copies > 1, windows)
        for parts in self._batches(self._parts(first, texts, mark), texts):
            self._sort(parts, texts, at, again)
        which = np.repeat(np.arange(len(same)), count)
        step = tk.ranges(np.zeros(len(count), np.int64), count)
        gone = np.flatnonzero(again[at[same[which]] + step] & (done[which] == 0))
        leaf, p = which[gone], pos[which[gone]] + step[gone]
        a = rp.runs_of(leaf, p - np.arange(len(p)))
        return leaf[a], p[a], np.diff(np.append(a, len(p)))

    def _parts(self, first: np.ndarray, texts: list[bytes], mark: np.ndarray) -> list[list[int]]:
        """Leaves of one minimiser that may have a window in common: those that agree on half a window to the left of the
        minimiser, or on the other half from it on, directly or by way of others."""
        left, right = self.window // 2, self.window - self.window // 2
        joined, size = np.frombuffer(b"".join([texts[i] for i in first.tolist()]), np.uint8), np.array([len(texts[i]) for i in first.tolist()], np.int64)
        begin = np.cumsum(size) - size
        anchor = np.flatnonzero(tk.byte_grams(joined, self.gram) == np.repeat(mark[first].view(np.uint64), size)[: max(0, len(joined) - self.gram + 1)])
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        seen: dict[tuple, int] = {}
        leaf = np.searchsorted(begin, anchor, "right") - 1
        within = set(first[np.flatnonzero(np.bincount(leaf, minlength=len(first)) > 1)].tolist())  # may repeat themselves
        marks = mark.tolist()
        for k, o in zip(first[leaf].tolist(), (anchor - begin[leaf]).tolist()):
            text = texts[k]
            if o >= left:
                up[top(k)] = top(seen.setdefault((marks[k], 0, text[o - left : o]), k))
            if len(text) - o >= right:
                up[top(k)] = top(seen.setdefault((marks[k], 1, text[o : o + right]), k))
        parts: dict[int, list[int]] = {}
        for k in sorted(up):
            parts.setdefault(top(k), []).append(k)
        return [p for p in parts.values() if len(p) > 1 or p[0] in within]

    @staticmethod
    def _batches(parts: list[list[int]], texts: list[bytes]):
        """Parts that are sorted at once, those of like length together: they need as many rounds (see ``suffix_arrays``)."""
        batch, held = [], 0
        for size, p in sorted((sum(len(texts[k]) + 1 for k in p), p) for p in parts):
            if batch and held + size > BATCH:
                yield batch
                batch, held = [], 0
            batch.append(p)
            held += size
        if batch:
            yield batch

    def _sort(self, parts: list[list[int]], texts: list[bytes], at: np.ndarray, again: np.ndarray) -> None:
        """Marks the windows that stand beside an equal one in the order of all suffixes of their part."""
        leaves = [k for p in parts for k in p]
        size = np.array([len(texts[k]) for k in leaves], np.int64)
        joined = np.frombuffer(b"\0".join([texts[k] for k in leaves]) + b"\0", np.uint8).astype(np.int16) + 1
        ends = np.cumsum(size + 1)
        joined[ends - 1] = 0  # ends a leaf
        own = np.full(len(joined), -1, np.int64)
        windows = size - self.window + 1
        own[tk.ranges(ends - size - 1, windows)] = tk.ranges(at[leaves], windows)
        bounds = np.concatenate(([0], ends[np.cumsum([len(p) for p in parts]) - 1]))
        order = suffix_arrays(joined, bounds)
        order = order[own[order] >= 0]
        views = np.lib.stride_tricks.sliding_window_view(joined, self.window)
        for lo in range(0, len(order) - 1, 4096):
            x, y = order[lo : lo + 4096], order[lo + 1 : lo + 4097]
            x = x[: len(y)]
            near = joined[x + self.window - 1] == joined[y + self.window - 1]
            near[near] = (views[x[near]] == views[y[near]]).all(1)
            again[own[x[near]]] = True
            again[own[y[near]]] = True

    def report(self, doc_ids, buf, offs, row, pos, many):
        gone = rp.covered(len(buf), offs[row] + pos, many + self.window - 1)
        data, out = buf.tobytes(), []
        for i in range(len(offs) - 1):
            a, b = int(offs[i]), int(offs[i + 1])
            g = gone[a:b]
            n = int(g.sum())
            kept = buf[a:b][~g].tobytes() if n else data[a:b]
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
            out.append((b - a, n, spans, hashlib.sha256(kept).hexdigest()) + ((kept, kept.decode(errors="ignore")) if self.texts else ()))
        columns = list(zip(*out))
        fields = FIELDS[: 5 + 2 * self.texts]
        return pa.table([doc_ids, *(pa.array(c, f[1]) for c, f in zip(columns, fields[1:]))], names=[f[0] for f in fields])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = 4 << 20, texts: bool = True, heavy: int = rp.HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, the kept bytes and
    their text (without the pieces of characters that were cut through) of each document."""
    return rp.remove_repeats(rp.whole(docs, id_col, text_col), ByteArrays(window, texts), pa.schema(FIELDS[: 5 + 2 * texts]), chunk_bytes, heavy)
