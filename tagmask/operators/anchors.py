"""Finding which of many strings a text may hold, without showing it all of them: keys of whole strings behind a filter.

A string goes by its length and a hash of its bytes, so a text meets those strings that it holds and hardly any other. Of a
text all runs of bytes of those lengths are hashed at once, and a filter of bounded size (a word of bits for each key, see
BITS_EACH) is tested where the text is, so that of its runs hardly any but the strings leave the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmask.sources.scratch import kept

#: Strings under so many bytes have no key: they are listed.
SHORTEST = 3
#: Longer strings go by their first so many bytes, and so do strings of rare lengths, so that at most so many lengths are looked for.
LONGEST, LENGTHS = 256, 128
#: Bits of the filter for each key, and at most (128 MB); more keys then let more runs through, never fewer.
BITS_EACH, MOST_BITS = 24, 1 << 30
#: Words of the filter that come to the driver as one row.
_BLOCK = 1 << 13

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The inverse of _ODD modulo 2 ** 64: runs are hashed from sums over the whole text.
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs_of(texts: list[bytes], owners: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of all runs of bytes of each length; hashes of different owners and lengths differ."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _powers(_ODD, len(data)), out=sums[1:])
    back = _powers(_INVERSE, len(data))
    for size in lengths:
        n = len(data) - size + 1
        if n < 1:
            continue
        whole = np.flatnonzero(of[:n] == of[size - 1 :])
        code = (sums[whole + size] - sums[whole]) * back[whole]
        yield of[whole], _mix(code ^ owners[of[whole]] ^ _mix(np.full(1, size, np.uint64)))


def _bits(key: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and the four bits in it that stand for a key."""
    again, mask = key * _ODD, np.zeros(len(key), np.uint64)
    for shift in (8, 20, 32, 44):
        mask |= np.uint64(1) << ((again >> np.uint64(shift)) & np.uint64(63))
    return (key & np.uint64(words - 1)).astype(np.int64), mask


def run_column(text: str, owner: Column, lengths: list[int], bits=None) -> Column:
    """Distinct keys (array<long>) of a text column: of its runs of all `lengths` that the (broadcast) filter has, or, without a
    filter, of its first bytes: as many as the largest of `lengths` that it has."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, owners in batches:
            texts = [b"" if v is None else v.encode() for v in values]
            keys = owners.to_numpy(np.int64).view(np.uint64)
            places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            if bits is None:
                sizes = np.array(lengths)[np.maximum(np.searchsorted(lengths, [len(t) for t in texts], "right") - 1, 0)] if texts else np.zeros(0, np.int64)
                for size in np.unique(sizes).tolist():
                    mine = [i for i in np.flatnonzero(sizes == size).tolist() if len(texts[i]) >= size]
                    for of, key in runs_of([texts[i][:size] for i in mine], keys[mine], [size]):
                        places.append(np.array(mine)[of])
                        found.append(key)
            else:
                table = bits.value
                for of, key in runs_of(texts, keys, lengths):
                    word, mask = _bits(key, len(table))
                    has = table[word] & mask == mask
                    places.append(of[has])
                    found.append(key[has])
            of, key = np.concatenate(places), np.concatenate(found)
            order = np.lexsort((key, of))
            of, key = of[order], key[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
            of, key = of[new], key[new].view(np.int64)
            cuts = np.searchsorted(of, np.arange(1, len(texts)))
            yield pd.Series(np.split(key, cuts) if len(texts) else [], dtype=object)

    return find(F.col(text), owner)


def lengths_of(strings: DataFrame, text: str) -> list[int]:
    """Lengths that strings go by, ascending: all there are, or, where these are too many, LENGTHS of them, the shortest among
    them, so that a string goes by the next one below its own."""
    size = F.least(F.octet_length(text), F.lit(LONGEST)).alias("n")
    counts = sorted((r.n, r["count"]) for r in strings.groupBy(size).count().filter(F.col("n") >= SHORTEST).collect())
    most = sorted(counts[1:], key=lambda x: (-x[1], x[0]))[: LENGTHS - 1]
    return sorted(n for n, _ in [*counts[:1], *most])


def keyed(strings: DataFrame, text: str, owner: str, lengths: list[int]) -> DataFrame:
    """The columns of `strings` plus `_key`. Strings under SHORTEST bytes have none and go."""
    return strings.withColumn("_key", F.explode_outer(run_column(text, F.xxhash64(owner), lengths))).filter("_key is not null")


def filter_of(keys: DataFrame) -> np.ndarray:
    """The filter of a (written) table's `_key`: its words are put together in tasks and come to the driver in blocks."""
    size, count = 1 << 13, keys.count()
    while size < min(MOST_BITS, BITS_EACH * count):
        size *= 2
    words = size // 64

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            word, mask = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), words)
            for block in np.unique(word // _BLOCK).tolist():
                mine = word // _BLOCK == block
                np.bitwise_or.at(parts.setdefault(block, np.zeros(min(_BLOCK, words), np.uint64)), word[mine] % _BLOCK, mask[mine])
        for block, part in parts.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "words": [part.tobytes()]})

    dealt = keys.select("_key").repartition(F.expr(f"(_key & {words - 1}L) div {_BLOCK}"))
    out = np.zeros(words, np.uint64)
    for row in dealt.mapInArrow(blocks, "block long, words binary").toLocalIterator():
        part = np.frombuffer(row.words, np.uint64)
        out[row.block * _BLOCK : row.block * _BLOCK + len(part)] |= part
    return out


def candidates(docs: DataFrame, strings: DataFrame, text: str, owner: str, entry: Column) -> DataFrame:
    """(owner, doc_id, _found): for documents (owner, doc_id, text) the entries of their owner's strings that they may hold."""
    lengths = lengths_of(strings, text)
    keys = kept(keyed(strings, text, owner, lengths))
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(keys))
    parts = docs.select(owner, "doc_id", F.explode_outer(run_column("text", F.xxhash64(owner), lengths, bits)).alias("_key")).filter("_key is not null")
    met = parts.join(keys.withColumnRenamed(owner, "_owner"), "_key").filter(F.col(owner) == F.col("_owner"))
    return met.groupBy(owner, "doc_id").agg(F.collect_set(entry).alias("_found"))
