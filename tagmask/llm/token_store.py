"""Token ids in succinct files: one wavelet matrix per shard.

A shard's ids are stored as bit planes, most significant first; after each plane the ids are split stably by its bit. A
plane is cut into compressed chunks with the number of ones before each, so that rank and select read few chunks, and
reading an id, counting an id in a range and finding its occurrences all work on the one compressed file.

File: magic, sections (8 bytes of length, zstandard frame) for the ids of documents, their ends, zeros per plane, ones before
each chunk and sizes of chunks, then the chunks, then CRC-32 of all before.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagmask.llm.common import new_path, read, written
from tagmask.llm.tokenise import Encoder
from tagmask.llm.vector_text import give_back, light

END_ID = 2
#: Ids in a file (more only where one document is longer), and bytes of a plane in a chunk.
SHARD_IDS, CHUNK = 4_000_000, 1 << 15
_MAGIC, _HEAD = b"WVMX0001", struct.Struct("<QQI")


def _section(values: np.ndarray) -> bytes:
    frame = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())
    return struct.pack("<Q", len(frame)) + frame


def encode_shard(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of a shard: unsigned ids, the documents' ids and where each document ends."""
    levels = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    ids = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    packer, zeros, before, sizes, chunks = zstandard.ZstdCompressor(level=1), [], [], [], []
    for level in range(levels - 1, -1, -1):
        bits = (ids >> level & 1).astype(bool)
        plane = np.packbits(bits, bitorder="little")
        ones = 0
        for at in range(0, len(plane), CHUNK):
            part = plane[at : at + CHUNK]
            frame = packer.compress(part.tobytes())
            before.append(ones)
            sizes.append(len(frame))
            chunks.append(frame)
            ones += int(np.bitwise_count(part).sum())
        zeros.append(len(ids) - ones)
        ids = np.concatenate([ids[~bits], ids[bits]])
    body = b"".join([_MAGIC, _HEAD.pack(len(ids), len(doc_ids), levels), _section(doc_ids.astype("<i8")), _section(ends.astype("<i8")), _section(np.array(zeros, "<i8")), _section(np.array(before, "<i8")), _section(np.array(sizes, "<i8")), *chunks])
    return body + struct.pack("<I", zlib.crc32(body))


class WaveletMatrix:
    """A shard file in memory. Positions count ids from 0 within the shard."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("not a whole shard file")
        self.length, docs, self.levels = _HEAD.unpack_from(data, 8)
        place, sections = 8 + _HEAD.size, []
        for _ in range(5):
            (size,) = struct.unpack_from("<Q", data, place)
            sections.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[place + 8 : place + 8 + size]), "<i8"))
            place += 8 + size
        self.doc_ids, self.ends, self.zeros, before, sizes = sections
        self.per_level = len(sizes) // self.levels
        self.before = before.reshape(self.levels, -1)
        self.places = place + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.data, self._open = data, {}

    def _chunk(self, level: int, chunk: int) -> np.ndarray:
        """The bits of a chunk; the last one of each level stays unpacked."""
        if self._open.get(level, (-1,))[0] != chunk:
            at = level * self.per_level + chunk
            raw = zstandard.ZstdDecompressor().decompress(self.data[self.places[at] : self.places[at + 1]])
            self._open[level] = (chunk, np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))
        return self._open[level][1]

    def rank(self, level: int, position: int) -> int:
        """Ones of a plane before a position."""
        if position >= self.length:
            return self.length - int(self.zeros[level])
        chunk, rest = divmod(position, CHUNK * 8)
        return int(self.before[level, chunk]) + int(self._chunk(level, chunk)[:rest].sum())

    def select(self, level: int, bit: int, n: int) -> int:
        """Position of the n-th (from 0) one or zero of a plane."""
        start = np.arange(self.per_level) * (CHUNK * 8)
        counts = self.before[level] if bit else start - self.before[level]
        chunk = int(np.searchsorted(counts, n, "right")) - 1
        bits = self._chunk(level, chunk)[: self.length - chunk * CHUNK * 8]
        return chunk * CHUNK * 8 + int(np.flatnonzero(bits == bit)[n - counts[chunk]])

    def access(self, position: int) -> int:
        """The id at a position."""
        value = 0
        for level in range(self.levels):
            chunk, rest = divmod(position, CHUNK * 8)
            bit, ones = int(self._chunk(level, chunk)[rest]), self.rank(level, position)
            position = int(self.zeros[level]) + ones if bit else position - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        if value >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self.rank(level, begin), self.rank(level, end)
            one = value >> (self.levels - 1 - level) & 1
            begin, end = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if one else (begin - a, end - b)
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id occurs in positions begin..end."""
        a, b = self._range(value, begin, self.length if end is None else end)
        return b - a

    def occurrence(self, value: int, n: int) -> int:
        """Position of the n-th (from 0) occurrence of an id; -1 if there are fewer."""
        begin, end = self._range(value, 0, self.length)
        if begin + n >= end:
            return -1
        position = begin + n
        for level in range(self.levels - 1, -1, -1):
            one = value >> (self.levels - 1 - level) & 1
            position = self.select(level, one, position - int(self.zeros[level]) if one else position)
        return position

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the splits from the last plane to the first."""
        ids = np.zeros(self.length, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            packed = b"".join(zstandard.ZstdDecompressor().decompress(self.data[self.places[at] : self.places[at + 1]]) for at in range(level * self.per_level, (level + 1) * self.per_level))
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.length, bitorder="little").astype(bool)
            before = np.empty_like(ids)
            before[~bits], before[bits] = ids[: self.zeros[level]], ids[self.zeros[level] :] | ids.dtype.type(1 << (self.levels - 1 - level))
            ids = before
        return ids


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of (doc_id, text) in ascending doc_id order; the list of files, in order: part, file, path, docs, ids.

    Null texts are empty, null ids come first, rows with equal ids stay beside each other. A task that is run again writes
    files under new names; only those that the returned (written) list names count.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(tokenizer_path), TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        ids, doc_ids, lengths, held, file = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, lengths, held, file
            name = f"{folder}/part-{part:06d}-{file:05d}-{uuid.uuid4().hex}.wvm"
            with store.open_output_stream(name) as out:
                out.write(encode_shard(np.concatenate(ids), np.array(doc_ids, np.int64), np.cumsum(lengths)))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([file], pa.int32()), "path": [name], "docs": [len(doc_ids)], "ids": [int(sum(lengths))]})
            ids, doc_ids, lengths, held, file = [], [], [], 0, file + 1
            return row

        end = np.array([end_id], np.int32)
        for batch in light(batches):
            names = batch.column("doc_id").to_pylist()
            for first, found, offsets in encode.encode(batch.column("text").to_pylist()):
                for i in range(len(offsets) - 1):
                    size = int(offsets[i + 1] - offsets[i]) + 1
                    if held and held + size > shard_ids:
                        yield flush()
                    ids += [found[offsets[i] : offsets[i + 1]], end]
                    doc_ids.append(-1 << 63 if names[first + i] is None else names[first + i])
                    lengths.append(size)
                    held += size
        if held:
            yield flush()
        del encode  # the worker lives on after the task
        give_back()

    return written(ordered.mapInArrow(write, "part int, file int, path string, docs long, ids long"), "tokens-list")


def read_shards(files: DataFrame, path: str) -> DataFrame:
    """Documents from a list of files: doc_id, start (ids before it), n_tokens, ids_crc32 and the ids themselves."""
    parts = files.groupBy("part").agg(F.sum("ids").alias("_ids"))
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("_file", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part").select("path", (F.col("_part") + F.col("_file")).cast("long").alias("start"))
    tasks = max(1, min(20_000, files.count()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(name) as file:
                    shard = WaveletMatrix(file.read())
                ids = shard.decode().astype("<u4")
                begins = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, shard.ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.doc_ids == -1 << 63), pa.array(start + begins), pa.array(shard.ends - begins), pa.array(crc, pa.int64()), pa.LargeListArray.from_arrays(pa.array(np.append(begins, len(ids))), pa.array(ids.view("<i4"))).cast(pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return written(placed, "tokens-starts").repartition(tasks).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to shard files and read back."""
    path = new_path(spark, "tokens")
    files = write_shards(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(files, path).select("doc_id", "start", "n_tokens", "ids_crc32")
