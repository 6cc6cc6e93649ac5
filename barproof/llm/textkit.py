"""Vectorised text kernels that run inside Spark tasks (numpy over Arrow buffers).

Every function works on a *packed* column: one uint8 buffer with the texts end
to end and an offsets array.  Null texts are empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
_STEP = U64(0xD1342543DE82EF95)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Spans of more bytes are hashed by a library, one by one.
LONG = 512

#: Bytes of white space: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def pack(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One text column -> (bytes, offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(offs: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about ``most`` bytes each (a longer text stands alone)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (``unmix`` undoes it)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_M1, _M2 = pow(0xC4CEB9FE1A85EC53, -1, 1 << 64), pow(0xFF51AFD7ED558CCD, -1, 1 << 64)


def unmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(33))
    x = x * U64(_M1)
    x ^= x >> U64(33)
    x *= U64(_M2)
    x ^= x >> U64(33)
    return x


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one integer (zeros beyond the end)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans.

    Eight bytes at a time go through ``mix``, each step depending on all before it: no linear
    recurrence, so texts with a pattern collide no more often than others.
    """
    at, n = eights(buf), ends - starts
    h = mix((at[starts] & _MASK[np.minimum(n, 8)]) ^ mix(n.astype(np.uint64) + _STEP))
    live, done = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(live):
        h[live] = mix(h[live] ^ (at[starts[live] + done] & _MASK[np.minimum(n[live] - done, 8)]))
        done += 8
        live = live[n[live] > done]
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def window_hash(buf: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of every ``width`` consecutive bytes, from halves that overlap (a width of 8 or more)."""
    if len(buf) < width:
        return np.zeros(0, np.uint64)
    h, size = mix(eights(buf)[: len(buf) - 7] + U64(seed * int(_STEP) % (1 << 64))), 8
    while size < width:
        step = min(size, width - size)
        h = mix(h[:-step] * _STEP + h[step:])
        size += step
    return h


def byte_grams(buf: np.ndarray, width: int) -> np.ndarray:
    """Cheaper hashes of every ``width`` consecutive bytes, good enough to deal texts out by."""
    if len(buf) < width:
        return np.zeros(0, np.uint64)
    if width < 8:
        return mix(eights(buf)[: len(buf) - width + 1] & _MASK[width])
    h, size = eights(buf)[: len(buf) - 7] * _STEP, 8
    while size < width:
        step = min(size, width - size)
        h ^= h >> U64(31)
        h = h[:-step] * _STEP + h[step:]
        size += step
    return mix(h)


def word_spans(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE):
    """Maximal runs of bytes that aren't separators, within one text -> starts, ends, index of the text."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separators[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[cuts < n]
    begin[cuts] |= inside[cuts]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    stop[cuts - 1] |= inside[cuts - 1]
    ends = np.flatnonzero(stop) + 1
    per_text = np.diff(np.searchsorted(starts, offs))
    return starts, ends, np.repeat(np.arange(len(offs) - 1), per_text)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _STEP
        out += h[i : i + n]
    return mix(out)


def sliding(a: np.ndarray, w: int, of=np.minimum) -> np.ndarray:
    """Minimum (or other idempotent ufunc) of every w consecutive entries."""
    n, width = len(a) - w + 1, 1
    if n <= 0:
        return a[:0]
    while 2 * width <= w:
        a = of(a[:-width], a[width:])
        width *= 2
    return of(a[:n], a[w - width : w - width + n]) if width < w else a[:n]


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all spans, end to end."""
    return buf[ranges(starts, lengths)]


def pressed(*arrays) -> bytes:
    """Arrays -> one compressed blob."""
    parts = [np.ascontiguousarray(a) for a in arrays]
    head = np.array([x for p in parts for x in (p.nbytes, ord(p.dtype.kind), p.dtype.itemsize)], dtype=np.int64)
    raw = np.int64(len(parts)).tobytes() + head.tobytes() + b"".join(p.tobytes() for p in parts)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpressed(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
    for size, kind, item in head.tolist():
        out.append(np.frombuffer(raw, np.dtype(f"{chr(kind)}{item}"), size // item, at))
        at += size
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of all ranges, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)


def split_by(keys: np.ndarray, n: int | None = None):
    """Stable grouping: yields (key, positions)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(k)]):
        yield k[a], order[a:b]


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts keys stably, start of each run, run index of each sorted entry)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    return order, np.flatnonzero(first), np.cumsum(first) - 1
