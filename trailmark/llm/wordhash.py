"""Vectorised word splitting and hashing for whole Arrow string columns.

A word is a maximal run of digits, letters or non-ASCII characters: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is
lower-cased.  Words never cross rows.  Every hash is a function of the word's bytes alone, so equal words hash equally in
every task, run and machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_M = (1 << 64) - 1


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: is it part of a word; the random value of its lower-cased form."""
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = True
    word[0x80:] = True
    fold = np.arange(256)
    fold[0x41:0x5B] += 32
    return word, mix(np.arange(1, 257, dtype=np.uint64))[fold]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_IS_WORD, _VALUE = _class_table()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    had = _powers.get(base)
    if had is None or len(had[0]) < n:
        size = max(1 << 12, 1 << int(np.ceil(np.log2(max(n, 2)))))
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        had = _powers[base] = (out[0], out[1])
    return had[0][:n], had[1][:n]


def rolling(values: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Hashes of all runs of k consecutive values (a Karp-Rabin hash, finalised)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


@dataclass
class Words:
    """The words of some rows, one after another; words of row i are first[i]:first[i + 1]."""

    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and where each row starts; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, (at - at[0] if len(at) else np.zeros(1, np.int64))


def hash_words(column: pa.Array, step: int = 1 << 20) -> Words:
    """Splits and hashes the words of a string column, about ``step`` bytes at a time."""
    raw, at = text_buffers(column)
    n = len(at) - 1
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, "right")) - 1)
        h, c = _hash_block(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        hashes.append(h)
        counts.append(c)
        lo = hi
    return Words(np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64))


def _hash_block(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    word = _IS_WORD[raw]
    new = word.copy()
    new[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    both = cut[word[cut] & word[cut - 1]]  # a word that would cross a row's start
    new[both] = True
    end[both - 1] = True
    start, stop = np.flatnonzero(new), np.flatnonzero(end) + 1
    up, down = powers(_BASE, len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up, out=total[1:])
    h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    return h, np.diff(np.searchsorted(start, at))
