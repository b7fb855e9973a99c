"""Words of Arrow text columns, cut and hashed as whole arrays of UTF-8 bytes.

A word is a run of bytes of one class, so classes are given for the 256 byte values; all bytes of
a character beyond ASCII have to be of one class. A-Z hash as a-z where ``fold`` is set. Nulls
count as empty texts. Hashes are 64 bits wide: a polynomial of random odd byte values modulo
2**64 (one running sum serves every word) with a finaliser over it and the length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BLOCK = 1 << 17
_U = np.uint64


def byte_class(outside: str) -> np.ndarray:
    """True for bytes that belong to words; ``outside``: the ASCII characters that don't."""
    table = np.ones(256, bool)
    table[list(outside.encode("ascii"))] = False
    return table


#: Words [^\x20\x09-\x0D]+
SPACED = byte_class(" \t\n\v\f\r")
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text with A-Z lower-cased
ALNUM = byte_class("".join(chr(c) for c in range(128) if not (chr(c).isascii() and chr(c).isalnum())))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(30))
        h = h * _U(0xBF58476D1CE4E5B9)
        h = h ^ (h >> _U(27))
        h = h * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of several, order counting."""
    with np.errstate(over="ignore"):
        h = np.full(np.shape(parts[0]), 0x9E3779B97F4A7C15, _U)
        for p in parts:
            h = mix(h * _U(0x9E3779B97F4A7C15) + p)
        return h


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[_U(1)], np.full(_BLOCK, base, _U)]), dtype=_U)
        down = np.cumprod(np.concatenate([[_U(1)], np.full(_BLOCK, inverse, _U)]), dtype=_U)
        exact = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    folded = exact.copy()
    folded[65:91] = exact[97:123]
    return up, down, exact, folded


UP, DOWN, EXACT, FOLDED = _tables()


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hash of each span; spans are in order and don't overlap. Works by blocks of bytes."""
    out = np.empty(len(starts), _U)
    values = FOLDED if fold else EXACT
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            a = int(starts[i])
            j = max(int(np.searchsorted(ends, a + _BLOCK, "right")), i + 1)
            b = int(ends[j - 1])
            if b - a > _BLOCK:  # one word longer than a block
                h, length = _U(0), b - a
                for p in range(a, b, _BLOCK):
                    v = values[buf[p : min(b, p + _BLOCK)]]
                    h = mix(h + (v * UP[: len(v)]).sum(dtype=_U))
                out[i] = mix(np.array([h + _U(length)]))[0]
            else:
                v = values[buf[a:b]]
                v *= UP[: b - a]
                c = np.empty(b - a + 1, _U)
                c[0] = 0
                np.cumsum(v, out=c[1:])
                s, e = starts[i:j] - a, ends[i:j] - a
                out[i:j] = (c[e] - c[s]) * DOWN[s] + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15)
            i = j
    return mix(out)


@dataclass
class Words:
    """buf: bytes; starts, ends: of each word; first: index of each text's first word, and the count."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def raw(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (and the last ends). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> Words:
    """Runs of bytes in the class; texts never share a word."""
    n = len(buf)
    if n == 0:
        return Words(buf, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    m = inside[buf]
    edges = offs[offs < n]
    before = np.zeros(n, bool)
    before[1:] = m[:-1]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = m[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offs))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values; summed text by text, so neighbours don't change rounding."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[:-1][some], axis=0)
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``size`` bytes of text, of one row at least."""
    for b in batches:
        column = b.column(b.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("")
        _, at = flat(column)
        i = 0
        while i < b.num_rows:
            j = max(int(np.searchsorted(at, at[i] + size, "right")) - 1, i + 1)
            yield b.slice(i, j - i)
            i = j


def mapper(text: str, each: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], size: int = CHUNK):
    """A function for mapInArrow that hands over chunks with their text as bytes."""

    def run(batches):
        for b in chunks(batches, text, size):
            yield each(b, *flat(b.column(b.schema.get_field_index(text))))

    return run


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the index of one of each, and each value's place among them."""
    return np.unique(h, return_index=True, return_inverse=True)
