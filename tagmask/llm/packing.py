"""Packing documents into sequences of bounded length by minimum bin slack.

A bin is seeded with the longest piece left; the fullest combination of the lengths still available that fits beside it
is found by subset-sum dynamic programming on a bit set, and removed. The search needs only how many pieces of each length
exist (at most `capacity` numbers), and a combination is taken as often as its pieces last, so the plan's size does not
depend on the number of documents. Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagmask.llm.common import read, written
from tagmask.llm.tokenise import Encoder
from tagmask.llm.vector_text import give_back, light

CAPACITY, END_ID = 4096, 1
#: Pieces that one ranking task should get about.
RANKED_TOGETHER = 50_000


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32.

    Every text (null: empty) becomes its ids and the end id; longer ones are cut every `capacity` ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_path)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in light(batches):
            for first, ids, offsets in encode.encode(batch.column("text").to_pylist()):
                ids = ids.astype("<u4")
                rows: list[tuple[int, int, int, int, int]] = []
                for i in range(len(offsets) - 1):
                    whole = np.concatenate([ids[offsets[i] : offsets[i + 1]], tail])
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        rows.append((first + i, piece, start, len(part), zlib.crc32(part.tobytes())))
                row, piece, start, length, crc = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        del encode  # the worker lives on after the task
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: list[int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths (descending; counts by length) with the largest sum up to `room`."""
    reach, goal, layers, full = 1, 1 << room, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, take = left - take, take * 2
        if reach & goal:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> target & 1:
            target -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination as length -> pieces, how many bins get it) for all pieces; every length is 1 to `capacity`."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    lengths, plan = sorted(counts, reverse=True), []
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        combination = fullest(left, lengths, capacity - seed)
        left[seed] += 1
        combination[seed] = combination.get(seed, 0) + 1
        times = min(left[length] // n for length, n in combination.items())
        for length, n in combination.items():
            left[length] -= n * times
        plan.append((combination, times))
        lengths = [length for length in lengths if left[length]]
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length: arrays (length, first rank, first bin, offset), sorted by length and rank."""
    rows, used, bins = [], {}, 0
    for combination, times in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            for _ in range(combination[length]):
                rows.append((length, used.get(length, 0), bins, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        bins += times
    rows.sort()
    return tuple(np.array(rows, np.int64).reshape(-1, 4).T)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, length, ...) -> all columns plus sequence_id and offset (names that clash are replaced).

    `pieces` is read more than once and should be a written table. Lengths are 1 to `capacity`. Repeated rows are packed
    as often as they occur; an empty table gives an empty result. Equal input gives equal packings.
    """
    pieces = pieces.drop("sequence_id", "offset")
    total = pieces.count()
    shards = max(8, min(4096, total // RANKED_TOGETHER))
    marked = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    # At most `capacity` x `shards` rows: where each shard's ranks begin among the pieces of a length.
    sizes = written(marked.groupBy("length", "_shard").agg(F.count("*").alias("_n")), "pack-sizes")
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = written(sizes.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_shard", "_begin"), "pack-begins")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(slots(plan_bins(counts, capacity)))
    within = Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "start")
    ranked = marked.withColumn("_rank", F.row_number().over(within) - 1).join(begins, ["length", "_shard"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_begin")).cast("long")).drop("_shard", "_begin")
    own = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, bins, offset = plan.value
        key = length * (1 << 48) + first
        for batch in batches:
            rank, size = np.asarray(batch.column("_rank")), np.asarray(batch.column("length"))
            at = np.searchsorted(key, size * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(bins[at] + rank - first[at]), pa.array(offset[at])], [*own, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Documents (doc_id, text; other columns are ignored) to packed pieces. Null and empty texts are the end id alone."""
    return pack(written(cut_pieces(docs, tokenizer_path, capacity, end_id), "pack-pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096."""
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
