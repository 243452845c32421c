"""Vectorised views of text columns inside Arrow tasks: blocks of UTF-8 bytes, words and their hashes.

Everything works on whole texts; a block only bounds how many documents are looked at together.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that one block holds (one longer document makes a block of its own).
BLOCK_BYTES = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Classes of characters: neither, numbers, letters and marks, and letters of scripts without blanks (each a word by itself).
OTHER, NUMBER, LETTER, ALONE = 0, 1, 2, 3
ALONE_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """Class of every code point."""
    global _classes
    if _classes is None:
        classes = np.zeros(0x110000, np.uint8)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        scripts = "".join(rf"\p{{{name}}}" for name in ALONE_SCRIPTS)
        for pattern, name in ((r"\p{N}+", NUMBER), (r"[\p{L}\p{M}]+", LETTER), (rf"[[{scripts}]&&\p{{L}}]+", ALONE)):
            for match in regex.finditer(pattern, everything, regex.V1):
                first, last = (i if i < 0xD800 else i + 0x800 for i in (match.start(), match.end() - 1))
                classes[first : last + 1] = name
        _classes = classes
    return _classes


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of unsigned integers."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256), 11)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, n + 1 of each."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n, BLOCK_BYTES) + 1
        up, down = np.full(size, _MULTIPLIER), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


@dataclass
class Block:
    """Documents first..first+len(docs) of a column: their bytes, and offsets[i]..offsets[i+1] of each."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def kinds(self) -> np.ndarray:
        """The class of every byte's character."""
        table = character_classes()
        kinds = table[:128][np.minimum(self.data, 127)]  # byte 127 is a control character
        lead = np.flatnonzero(self.data >= 0xC0)
        if len(lead):
            b = np.concatenate([self.data, np.zeros(3, np.uint8)]).astype(np.int64)
            kinds = np.concatenate([kinds, np.zeros(3, np.uint8)])
            size = 2 + (b[lead] >= 0xE0) + (b[lead] >= 0xF0)
            for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
                at = lead[size == n]
                code = b[at] & mask
                for i in range(1, n):
                    code = code << 6 | b[at + i] & 0x3F
                kind = table[np.minimum(code, 0x10FFFF)]
                for i in range(n):
                    kinds[at + i] = kind
            kinds = kinds[: len(self.data)]
        return kinds

    def runs(self, inside: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every run of bytes for which `inside` holds, never across documents; `cut` begins a new run."""
        on = np.zeros(len(inside) + 1, bool)
        on[1:-1] = inside[1:] & inside[:-1]
        on[self.offsets] = False
        if cut is not None:
            on[:-1] &= ~cut
        return np.flatnonzero(inside & ~on[:-1]), np.flatnonzero(inside & ~on[1:]) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word: a run of letters, marks and numbers, or one letter of a script without blanks."""
        alone = self.kinds == ALONE
        if not alone.any():
            return self.runs(self.kinds > OTHER)
        near = alone.copy()
        near[1:] |= alone[:-1]
        return self.runs(self.kinds > OTHER, near & (self.data & 0xC0 != 0x80))

    def before(self, flags: np.ndarray) -> np.ndarray:
        """The flag of the byte before each byte; False where a document begins."""
        out = np.zeros(len(flags) + 1, bool)
        out[1:] = flags
        out[self.offsets] = False
        return out[:-1]

    def after(self, flags: np.ndarray) -> np.ndarray:
        """The flag of the byte after each byte; False where a document ends."""
        out = np.zeros(len(flags) + 1, bool)
        out[:-1] = flags
        out[self.offsets] = False
        return out[1:]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        """The document (from 0 in this block) of each byte position."""
        return np.searchsorted(self.offsets, places, "right") - 1

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sum over each document of a value per byte."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self) -> Hashes:
        return Hashes(self.data)


class Hashes:
    """64-bit hashes of any byte ranges of a block."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts], seed)


def as_text(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> pa.Array:
    """The column as one large_string array without nulls (null is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def blocks(text: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a large_string array."""
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Block(first, everything[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def give_back() -> None:
    """Return memory that a finished task no longer uses: workers live on, and their free memory counts for the executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def light(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 * BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` bytes of text, so that copies of a batch stay small."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        first = 0
        while first < batch.num_rows:
            used = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, used + limit, "right")))
            yield batch.slice(first, last - first)
            first = last
    give_back()
