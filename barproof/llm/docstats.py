"""Counts per text that several operators share, made by whole batches.

Words, lines and windows are compared within one text only: lines by their bytes,
words and windows of words by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barproof.llm import repeats as rp
from barproof.llm import textkit as tk

U64 = np.uint64
REPEAT = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?")] = True
#: A code point begins at each byte that continues none.
BEGINS = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_marks", "n_distinct", "n_long")
SQL = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Every entry of COUNTS for each text."""
    n = len(offs) - 1
    starts, ends, doc = tk.word_spans(buf, offs)
    h = tk.span_hash(buf, starts, ends)
    space = tk.SPACE[buf]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": per_text(BEGINS[buf] & ~space, offs), "n_symbols": per_text(SYMBOLS[buf], offs)}
    out["n_digits"] = per_text((buf >= 0x30) & (buf <= 0x39), offs)
    out["n_upper"] = per_text((buf >= 0x41) & (buf <= 0x5A), offs)
    out["n_marks"] = per_text(PUNCTUATION[buf], offs)
    out["n_long"] = np.bincount(doc[ends - starts > 20], minlength=n)
    gone = np.zeros(len(doc), bool)
    if len(doc) >= REPEAT:
        at = np.flatnonzero(doc[: 1 - REPEAT] == doc[REPEAT - 1 :])
        order, first, run = tk.groups_of(tk.mix(tk.gram_hash(h, REPEAT)[at] + doc[at].astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
        gone = rp.covered(len(doc), at[order[(np.diff(np.append(first, len(at))) > 1)[run]]], REPEAT)
    out["n_repeat_words"] = np.bincount(doc[gone], minlength=n)
    order, first, _ = tk.groups_of(tk.mix(h + doc.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))
    out["n_distinct"] = np.bincount(doc[order[first]], minlength=n)
    raw, dup, lines = buf.tobytes(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        if b"\n" in (text := raw[offs[i] : offs[i + 1]]):
            own = [x for x in text.split(b"\n") if x and not x.isspace()]
            dup[i], lines[i] = len(own) - len(set(own)), len(own)
        else:
            lines[i] = bool(text) and not text.isspace()
    return out | {"n_dup_lines": dup, "n_lines": lines}


def count_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of each text, in one pass; null and empty texts count nothing."""

    def run(batches):
        for batch in batches:
            buf, offs = tk.pack(batch.column("text"))
            for lo, hi in tk.slices(offs):
                c = counts(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *(pa.array(c[k], pa.int64()) for k in COUNTS)], schema=SCHEMA)

    return rp.whole(docs, id_col, text_col).mapInArrow(run, SQL)
