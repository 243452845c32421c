"""Public BPE tokenizers over whole text columns.

A BPE tokenizer cuts a text into pieces by a fixed pattern and encodes each piece by itself. Here the cutting is done for
whole blocks of text at once (classes of characters, compared with their neighbours), pieces seen before are looked up,
and the BPE model of the tokenizers library encodes each new one. The ids are those of `Tokenizer.encode` with
add_special_tokens=False on the whole text. Texts that hold the string of a special token go to that method whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tagmask.llm.vector_text import mix

#: Characters looked at together (one longer text makes a block of its own), and distinct pieces remembered by a task.
BLOCK_CHARS, REMEMBERED = 300_000, 400_000
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
#: Fixed values of the pieces' pattern: letters that may follow an apostrophe, one or two.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    global _classes
    if _classes is None:
        classes = np.zeros(0x110000, np.uint8)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, name in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for match in regex.finditer(pattern, everything):
                shift = lambda i: i if i < 0xD800 else i + 0x800
                classes[shift(match.start()) : shift(match.end() - 1) + 1] = name
        _classes = classes
    return _classes


class Pieces:
    """Cuts texts by the pattern of a byte-level BPE (`words=False`) or of a BPE with word ends (`words=True`)."""

    def __init__(self, words: bool):
        self.words = words

    def starts(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece starts here, class) of every character; first: places where texts begin."""
        n, kind = len(code), character_classes()[code]
        before = np.empty(n, np.uint8)
        before[1:] = kind[:-1]
        begin = np.zeros(n + 1, bool)
        begin[first] = True
        begin = begin[:n]
        differs = (kind != before) | begin
        start = differs.copy()
        if self.words:
            start |= kind == NUMBER  # each number character is a piece
        else:
            blank = np.zeros(n, bool)
            blank[1:] = code[:-1] == 0x20
            start &= ~(blank & ~begin & (kind != SPACE))  # a blank before letters, numbers or others belongs to them
            last = np.zeros(n, bool)
            last[:-1] = differs[1:] & (kind[1:] != SPACE) & ~begin[1:]
            start |= (kind == SPACE) & last  # the last of several white spaces before text stands alone or joins it
        # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
        for at in np.flatnonzero((code == 0x27) & start):
            if kind[at] != OTHER:
                continue
            end = n if at + 1 >= n else at + 1
            one = chr(code[end]) if end < n and not begin[end] else ""
            two = one + chr(code[end + 1]) if one and end + 1 < n and not begin[end + 1] else ""
            length = 1 if one and one in ONE_LETTER else 2 if two in TWO_LETTERS else 0
            if length:
                start[at + 1 : at + 1 + length] = False
                if at + 1 + length < n:
                    start[at + 1 + length] = True
        return start, kind


class Remembered:
    """A hash table from short pieces (at most 15 bytes, compared exactly) to numbers, looked up by whole arrays."""

    SLOTS, LONGEST = 1 << 20, 15

    def __init__(self):
        #: First eight bytes; the following seven under the size (never 0, so 0 marks a free slot); number.
        self.head, self.tail = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.code = np.zeros(self.SLOTS, np.int32)
        self.used = 0

    @staticmethod
    def keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(head, tail) of pieces of at most 15 bytes."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        low = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
        head = eight[begin] & low[np.minimum(size, 8)]
        tail = eight[np.minimum(begin + 8, len(data))] & low[np.clip(size - 8, 0, 7)]
        return head, tail | size.astype(np.uint64) << np.uint64(56)

    def slot(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return (mix(head ^ tail * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def find(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Numbers of the pieces, -1 for new ones."""
        slot = self.slot(head, tail)
        there = self.tail[slot]
        same = (there == tail) & (self.head[slot] == head)
        found = np.where(same, self.code[slot], -1)
        left = np.flatnonzero(~same & (there > 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)
            at = slot[left]
            there = self.tail[at]
            same = (there == tail[left]) & (self.head[at] == head[left])
            found[left[same]] = self.code[at[same]]
            left = left[~same & (there > 0)]
        return found

    def add(self, head: np.ndarray, tail: np.ndarray, code: np.ndarray) -> None:
        """Put in distinct new pieces, until half of the slots are used; the others stay new."""
        left = np.arange(min(len(head), self.SLOTS // 2 - self.used))
        slot = self.slot(head[left], tail[left])
        self.used += len(left)
        while len(left):
            at, one = np.unique(slot[left], return_index=True)
            free = self.tail[at] == 0
            at, put = at[free], left[one[free]]
            self.head[at], self.tail[at], self.code[at] = head[put], tail[put], code[put]
            waiting = np.ones(len(slot), bool)
            waiting[put] = False
            left = left[waiting[left]]
            taken = self.tail[slot[left]] > 0
            slot[left[taken]] = (slot[left[taken]] + 1) & (self.SLOTS - 1)


def byte_letters() -> np.ndarray:
    """The code point that stands for each byte in a byte-level BPE: itself if it is a visible Latin-1 character, else the next from 256 on."""
    visible = np.zeros(256, bool)
    for first, last in (("!", "~"), ("\xa1", "\xac"), ("\xae", "\xff")):
        visible[ord(first) : ord(last) + 1] = True
    return np.where(visible, np.arange(256), 255 + np.cumsum(~visible)).astype("<u4")


class Encoder:
    """ids of whole texts, with a bounded memory of the pieces seen."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = self.tokenizer.normalizer is not None
        self.pieces = Pieces(self.words)
        self.forget()

    def forget(self) -> None:
        """Let go of the pieces seen."""
        self.known, self.count, self.filled = Remembered(), 0, 0
        self.begins, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)

    def _prepared(self, text: str) -> str:
        """Normalised as the tokenizer does; below U+0300 that is lower case (no composition, no special cases but U+0130)."""
        if not self.words:
            return text
        if text.isascii() or ("İ" not in text and np.frombuffer(text.encode("utf-8", "replace"), np.uint8).max() < 0xCC):
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Encode distinct pieces; their numbers, places in self.begins and self.lengths."""
        _, ends, data = pieces.buffers()
        places = np.frombuffer(ends, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        spelt = self.letters[np.frombuffer(data, np.uint8)[: places[-1]]].tobytes().decode("utf-32-le")
        tokenize, ids, sizes = self.model.tokenize, [], []
        bounds = places.tolist()
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            found = tokenize(spelt[begin:end])
            sizes.append(len(found))
            ids.extend([t.id for t in found])
        first, self.count = self.count, self.count + len(sizes)
        while self.count > len(self.begins):
            self.begins, self.lengths = np.tile(self.begins, 2), np.tile(self.lengths, 2)
        while self.filled + len(ids) > len(self.flat):
            self.flat = np.tile(self.flat, 2)
        self.lengths[first : self.count] = sizes
        self.begins[first : self.count] = self.filled + np.cumsum(sizes) - sizes
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        return np.arange(first, self.count)

    def _codes(self, pieces: pa.Array, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the pieces; new pieces are encoded, and remembered if they are short."""
        if self.count > REMEMBERED:
            self.forget()
        size = end - begin
        short = size <= Remembered.LONGEST
        head, tail = self.known.keys(data, begin, np.minimum(size, Remembered.LONGEST))
        codes = self.known.find(head, tail)
        codes[~short] = -1
        new = np.flatnonzero(codes < 0)
        if len(new):
            coded = pieces.take(pa.array(new)).dictionary_encode()
            index, numbers = np.asarray(coded.indices), self._learn(coded.dictionary)
            codes[new] = numbers[index]
            one = np.zeros(len(numbers), np.int64)
            one[index[::-1]] = new[::-1]
            one = one[short[one]]
            self.known.add(head[one], tail[one], codes[one])
        return codes

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, offsets) for blocks of texts; the ids of text first + i are ids[offsets[i]:offsets[i + 1]]."""
        first = 0
        while first < len(texts):
            block, size = [], 0
            while first + len(block) < len(texts) and (not block or size + len(texts[first + len(block)] or "") <= BLOCK_CHARS):
                text = texts[first + len(block)] or ""
                if any(s in text for s in self.special):
                    break
                block.append(self._prepared(text))
                size += len(block[-1])
            if block:
                yield first, *self._block(block)
                first += len(block)
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
                yield first, ids, np.array([0, len(ids)])
                first += 1

    def _block(self, block: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(block)
        data = joined.encode("utf-8", "replace")
        ends = np.cumsum([0, *map(len, block)])
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(block) + 1, np.int64)
        code = np.frombuffer(data, np.uint8) if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        start, kind = self.pieces.starts(code, ends[:-1])
        at = np.flatnonzero(start)
        if len(data) == len(code):
            byte = np.append(at, len(code))
        else:
            width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            byte = np.append(np.cumsum(width)[at] - width[at], len(data))
        begin, end = byte[:-1], byte[1:]
        pieces = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(byte.astype(np.int32)), pa.py_buffer(data)])
        if self.words:
            keep = kind[at] != SPACE
            begin, end, at, pieces = begin[keep], end[keep], at[keep], pieces.filter(pa.array(keep))
        codes = self._codes(pieces, np.frombuffer(data, np.uint8), begin, end)
        lengths = self.lengths[codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begins[codes] - total[:-1], lengths)]
        return ids, total[np.searchsorted(at, ends, "left")]
