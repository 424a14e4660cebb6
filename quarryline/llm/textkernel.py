"""Words, lines and their hashes of a whole Arrow batch of texts, by NumPy.

A batch is cut into slices of about SLICE bytes (a longer text is a slice of its own) so
that the working arrays stay small. Words are the runs of bytes other than ASCII white
space; as UTF-8 keeps ASCII bytes to ASCII characters, this equals the rule on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift, twice; equal inputs give equal outputs."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as doubles above 0 and up to 1."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


@lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    v = mixed(np.arange(1, 257, dtype=U64))
    if lower:
        v[65:91] = v[97:123]
    return v


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for so far."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def first(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, SLICE + 4096)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                run = np.full(size, base, dtype=U64)
                run[0] = 1
                setattr(cls, name, np.cumprod(run))
        return cls.up[:n], cls.down[:n]


@dataclass
class Words:
    """The words of one slice of texts. Offsets are in bytes of data."""

    first: int  # of the slice's texts, in the batch
    data: np.ndarray
    text_at: np.ndarray  # n + 1 offsets
    start: np.ndarray
    end: np.ndarray
    word_at: np.ndarray  # n + 1 indices into start
    prefix: np.ndarray  # len(data) + 1 sums for hashes

    @property
    def n(self) -> int:
        return len(self.text_at) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word, from 0 within the slice."""
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], for arrays of spans."""
        down = _Powers.first(len(self.data) + 1)[1]
        return mixed((self.prefix[end] - self.prefix[start]) * down[start])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        return summed(flags, self.text_at)


def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between neighbours of at; int64."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of an array of strings; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes together, one text at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(texts: pa.Array, lower: bool = False, size: int = SLICE) -> Iterator[Words]:
    """Slice by slice; lower: A-Z hash as a-z."""
    data, at = raw(texts)
    for i, j in pieces(at, size):
        part = data[at[i] : at[j]]
        text_at = at[i : j + 1] - at[i]
        seen = ~_SPACE[part]
        before = np.empty_like(seen)
        before[:1] = False
        before[1:] = seen[:-1]
        heads = text_at[:-1][np.diff(text_at) > 0]
        before[heads] = False
        first = seen & ~before
        start = np.flatnonzero(first)
        after = np.empty_like(seen)
        after[-1:] = False
        after[:-1] = seen[1:]
        after[text_at[1:][np.diff(text_at) > 0] - 1] = False
        end = np.flatnonzero(seen & ~after) + 1
        word_at = np.searchsorted(start, text_at)
        prefix = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(_byte_values(lower)[part] * _Powers.first(len(part))[0], out=prefix[1:])
        yield Words(i, part, text_at, start, end, word_at, prefix)


def windows(hashes: np.ndarray, word_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside each text, and the n + 1 indices into them.

    A text of one to k - 1 words has one window, of all its words.
    """
    counts = np.diff(word_at)
    n = np.maximum(counts - k + 1, np.minimum(counts, 1))
    at = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=at[1:])
    head = np.arange(at[-1]) + np.repeat(word_at[:-1] - at[:-1], n)
    short = np.repeat(np.minimum(counts, k), n)
    out = np.zeros(len(head), dtype=U64)
    for i in range(k):
        here = short > i
        if here.all():
            out = (out + hashes[head + i]) * U64(0xC2B2AE3D27D4EB4F)
        else:
            out[here] = out[here] + hashes[head[here] + i]
            out *= U64(0xC2B2AE3D27D4EB4F)
    return mixed(out), at


def tagged(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mixed(hashes + mixed(owner.astype(U64) + U64(1)))


def repeated(values: np.ndarray) -> np.ndarray:
    """Flags of the values found twice or more."""
    run = np.sort(values)
    twice = run[1:][run[1:] == run[:-1]]
    if not len(twice):
        return np.zeros(len(values), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values
