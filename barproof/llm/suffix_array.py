"""Suffix arrays by prefix doubling, of one string or of many at once.

Suffixes are first ordered by as many symbols as fit into one integer; a suffix's
rank is the first place of those that are equal so far.  What is ordered by h symbols
is then ordered by 2h: within a rank, suffixes follow the ranks of the suffixes that
begin h symbols later.  Only suffixes that still share their rank are sorted again,
so what differs early costs one sort.  A string's end is below all symbols, so no
two suffixes of a string stay equal.

Strings never meet: their number is the first symbol, and ranks are looked up within
a string only.  All work is on whole arrays, the rounds grow with the logarithm of
the longest repeat.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The suffix arrays of all strings text[offs[k]:offs[k+1]], end to end, as positions in ``text``."""
    n, size = len(text), np.diff(offs)
    if not n:
        return np.zeros(0, np.int64)
    end = np.repeat(np.asarray(offs[1:], np.int64), size)
    key, h = _first_symbols(text, np.repeat(np.arange(len(size)), size), end)
    order, rank = np.argsort(key), np.empty(n, np.int64)
    tied = _ranked(key[order], order, np.arange(n), rank)
    while len(tied):
        at = order[tied]
        later = at + h
        within = later < end[at]
        key = rank[at] * (n + 1)
        key[within] += rank[later[within]] + 1
        by = np.argsort(key)
        order[tied] = at = at[by]
        tied = _ranked(key[by], at, tied, rank)
        h *= 2
    return order


def _first_symbols(text: np.ndarray, string: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """For each suffix, its string and its first symbols (0: beyond the end) in one integer, and how many symbols."""
    n, symbols = len(text), text.astype(np.int64) - int(text.min()) + 1
    bits = int(symbols.max()).bit_length()
    many = max(1, (63 - int(string[-1]).bit_length()) // bits)
    key, left = string << bits * many, end - np.arange(n)
    for k in range(min(many, n)):
        key[: n - k] |= np.where(left[: n - k] > k, symbols[k:], 0) << bits * (many - 1 - k)
    return key, many


def _ranked(key: np.ndarray, at: np.ndarray, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Gives suffixes, in order and at these places, the first place of their key, and returns the places of those that share it."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    many = np.diff(np.append(first, len(key)))
    rank[at] = np.repeat(places[first], many)
    return places[np.repeat(many > 1, many)]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of an array of small integers, in lexicographic order (a prefix comes first)."""
    return suffix_arrays(text, np.array([0, len(text)]))
