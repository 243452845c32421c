"""Near-duplicate detection by DartMinHash signatures, banded joining and exact checking.

A text is a weighted set: its shingles of five words, each weighing as often as it occurs. DartMinHash throws hashed darts
at the region (weight x rank) of every element; a dart lands in a coordinate, and the earliest dart of each coordinate is
the signature. Equal coordinates have the probability of the weighted Jaccard similarity. Texts that share a band of
coordinates are candidates and are compared exactly; links of 0.8 or more make classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.llm.common import BROADCAST_ROWS, attach, only_last, read, renamed, written
from tagmask.llm.vector_text import OTHER, Block, as_text, blocks, light, mix

SHINGLE, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares none of 40 bands of 6 coordinates with probability 5e-6, one of 0.3 shares some with 0.03.
BANDS, ROWS = 40, 6


def shingles(block: Block, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of `words` words; of texts with fewer words, the one run of all of them."""
    starts, ends = block.words()
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word, doc = block.hashes().of(starts, ends), block.doc_of(starts)
    count = np.bincount(doc, minlength=block.docs)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    left = count[doc] - (np.arange(len(doc)) - first[doc])
    keep = (left >= words) | ((count[doc] < words) & (left == count[doc]))
    run = np.zeros(len(word), np.uint64)
    padded = np.concatenate([word, np.zeros(words, np.uint64)])
    for i in range(words):
        run = mix(run ^ np.where(left > i, padded[i : i + len(word)], 0).astype(np.uint64), i)
    return run[keep], doc[keep]


def cells(element: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of a multiset: (hash of element and which occurrence it is, document), sorted by document and hash."""
    order = np.lexsort((element, doc))
    element, doc = element[order], doc[order]
    new = np.ones(len(element), bool)
    new[1:] = (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(element)), 0))
    return mix(element ^ mix(np.arange(len(element)) - begin, 17), 18), doc


def strips(element: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Dart regions of a multiset whose weights are counts: (region, document, low, width, weight).

    An element's axis is cut at 1, 2, 4, 8, ... independently of its weight, so an element that occurs n times has about
    log2(n) strips, of which only the last may be covered in part.
    """
    order = np.lexsort((element, doc))
    element, doc = element[order], doc[order]
    new = np.ones(len(element), bool)
    new[1:] = (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(element)))
    levels = 1 + np.ceil(np.log2(times)).astype(np.int64)
    which = np.repeat(np.arange(len(at)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level, np.exp2(level - 1), 1.0)
    return mix(element[at][which] ^ mix(level, 17), 18), doc[at][which], np.where(level, width, 0.0), width, times[which].astype(float)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def dart_signature(region: np.ndarray, doc: np.ndarray, docs: int, coordinates: int, low: np.ndarray | None = None, width: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Signatures (documents x coordinates) of weighted sets given as dart regions.

    A region is a strip of an element's weight axis (low .. low + width), with a hash of its own; without `low` all
    strips have width 1 and are covered wholly. Darts fall on a strip as a Poisson process in rank
    (rate `width`), each at a hashed place in the strip and in a hashed coordinate; those above the element's weight
    are missed. Ranks are followed up to a bound at which a document's coordinates are likely all hit, and further
    where some are not. Documents without regions have coordinates 0.
    """
    best = np.full(docs * coordinates, np.inf)
    sign = np.zeros(docs * coordinates, np.uint64)
    total = np.bincount(doc, np.ones(len(doc)) if weight is None else np.minimum(width, weight - low), docs)
    bound = (coordinates * math.log(coordinates) + 2 * coordinates) / np.maximum(total, 1e-300)
    rank, state, at = np.zeros(len(region)), region.copy(), np.arange(len(region))
    loose = None if low is None else low + width > weight
    while len(at):
        alive = at
        while len(alive):
            state[alive] = mix(state[alive], 21)
            step = -np.log(_uniform(mix(state[alive], 22)))
            rank[alive] += step if width is None else step / width[alive]
            alive = alive[rank[alive] < bound[doc[alive]]]
            dart, r, d = state[alive], rank[alive], doc[alive]
            if loose is not None and loose[alive].any():
                inside = ~loose[alive]
                some = np.flatnonzero(~inside)
                inside[some] = low[alive[some]] + width[alive[some]] * _uniform(mix(dart[some], 24)) < weight[alive[some]]
                dart, r, d = dart[inside], r[inside], d[inside]
            place = d * coordinates + (mix(dart, 23) % np.uint64(coordinates)).astype(np.int64)
            before = best[place]
            better = r < before
            place, r, dart = place[better], r[better], dart[better]
            np.minimum.at(best, place, r)
            won = best[place] == r
            sign[place[won]] = dart[won]
        # Ranks above the bound are not used up: the next round starts from the last dart that lay beyond it.
        empty = np.isinf(best).reshape(docs, coordinates).any(1) & (total > 0)
        at = np.flatnonzero(empty[doc])
        if len(at):
            docs_left = np.flatnonzero(empty)
            best.reshape(docs, coordinates)[docs_left] = np.inf
            rank[at], state[at] = 0.0, region[at]
            bound[docs_left] *= 2
    return sign.reshape(docs, coordinates)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash per band of `rows` coordinates; bands in different places differ."""
    count = signature.shape[1] // rows
    out = np.zeros((len(signature), count), np.uint64)
    for i in range(rows):
        out = mix(out ^ signature[:, i : count * rows : rows], 31 + i)
    return mix(out ^ mix(np.arange(count), 30), 29)


def _normal_forms(block: Block) -> list[bytes]:
    """Every text as its words with one blank between; equal for texts of equal words."""
    word = block.kinds > OTHER
    after = np.zeros_like(word)
    after[1:] = word[:-1]
    after[block.offsets[:-1][block.offsets[:-1] < len(word)]] = False
    kept = word | after
    data = np.where(word, block.data, 32).astype(np.uint8)[kept].tobytes()
    places = np.concatenate([[0], np.cumsum(kept)])[block.offsets].tolist()
    return [data[a:b].strip() for a, b in zip(places[:-1], places[1:], strict=True)]


def _signer(words: int, count: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches):
            for block in blocks(as_text(batch.column("text"), lower=True)):
                element, doc = shingles(block, words)
                weight = np.bincount(doc, minlength=block.docs)
                region, doc, low, width, times = strips(element, doc)
                band = bands(dart_signature(region, doc, block.docs, count * rows, low, width, times), rows).view(np.int64)
                some = weight > 0
                ends = np.concatenate([[0], np.cumsum(some * count)]).astype(np.int32)
                key = [hashlib.blake2b(text, digest_size=16).digest() for text in _normal_forms(block)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.docs), pa.array(key, pa.binary()), pa.array(weight, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(band[some].ravel()))], ["doc_id", "key", "weight", "bands"])

    return sign


def _cell_lists(words: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches):
            for block in blocks(as_text(batch.column("text"), lower=True)):
                element, doc = cells(*shingles(block, words))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=block.docs))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.docs), pa.ListArray.from_arrays(pa.array(ends), pa.array(element.view(np.int64)))], ["id", "cells"])

    return listed


def _compare(threshold: float):
    """Links between different classes among the texts of one block of a bucket, one per pair of classes."""

    def compare(table: pa.Table) -> pa.Table:
        lists = table.column("cells").combine_chunks()
        comp = np.asarray(table.column("comp").combine_chunks())
        size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        doc, values = np.repeat(np.arange(len(size)), size), np.asarray(lists.flatten())
        for _ in range(2):  # a partner shares at least this part of a text's cells
            _, code, times = np.unique(values, return_inverse=True, return_counts=True)
            shared = times[code] > 1
            doc, values = doc[shared], values[shared]
            alive = np.bincount(doc, minlength=len(size)) >= threshold * size - 1e-9
            doc, values = doc[alive[doc]], values[alive[doc]]
        rows = np.unique(doc)
        a = b = np.zeros(0, np.int64)
        if len(np.unique(comp[rows])) > 1:
            place, cell = np.searchsorted(rows, doc), np.unique(values, return_inverse=True)[1]
            common = np.zeros((len(rows), len(rows)), np.float32)
            for low in range(0, int(cell.max()) + 1, 4096):
                some = (cell >= low) & (cell < low + 4096)
                part = np.zeros((len(rows), min(4096, int(cell.max()) + 1 - low)), np.float32)
                part[place[some], cell[some] - low] = 1
                common += part @ part.T
            total = (size[rows][:, None] + size[rows][None, :]).astype(np.float64)
            linked = (common * (1 + threshold) >= threshold * total - 1e-6) & (comp[rows][:, None] < comp[rows][None, :])
            i, j = np.nonzero(linked)
            pairs = np.unique(np.stack([comp[rows[i]], comp[rows[j]]], 1), axis=0)
            a, b = pairs[:, 0], pairs[:, 1]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, comp): the smallest id that each id is linked to, by large-star and small-star rounds."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state is not None and tuple(new) == state:
            break
        state = tuple(new)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hubs = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = written(hubs.filter("u <> v").distinct(), "links-small")
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


#: Ids up to which a set of ids is broadcast to pick texts without shuffling them, and texts in one block of a bucket.
PICKED_IDS, BLOCK = 500_000, 1000


def _digest(text: Column | str = "text") -> Column:
    """A text as 32 bytes; null texts as none."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def _row_keys(base: DataFrame) -> DataFrame:
    """(doc_id, text) with repeated ids -> the distinct rows with digest, extra and a key of their own.

    The key is the id for one text of every id (the smallest digest); for the others (extra) it is a hash of id and text.
    Keys are counted, and hashed anew should two be equal.
    """
    single = written(base.withColumn("digest", _digest()).dropDuplicates(["doc_id", "digest"]), "dup-single")
    several = written(single.groupBy("doc_id").agg(F.min("digest").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "dup-several")
    marked = attach(single, several, ["doc_id"], "digest").withColumn("extra", F.coalesce(F.col("digest") != F.col("least"), F.lit(False))).drop("least")
    seed = 0
    while True:
        key = F.when(F.col("extra"), F.xxhash64(F.lit(seed), "doc_id", "digest")).otherwise(F.col("doc_id"))
        keyed = written(marked.withColumn("key", key), "dup-keyed")
        if keyed.groupBy("key").count().filter("count > 1").isEmpty():
            return keyed
        seed += 1


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text) -> one row per row: doc_id, class_id (the smallest id of its class), kept (is it that id).

    Texts of equal words are one class at once. Of the others, those in a bucket (an equal band) are compared with the
    bucket's most central text; where a bucket then still has several classes, its texts are compared across classes in
    blocks of bounded size, so that no pair of a bucket is left out. Comparison is exact (weighted Jaccard similarity of
    shingle counts, words lower-cased, punctuation left out). Null and empty texts have no words and are one class. Rows
    that repeat id and text are one document; rows that only share an id, or have none, are documents of their own. A
    null id counts as the smallest number. Of an id with several texts one names classes by the id; a class of none but
    the others is named by a hash, and kept goes by row, not by id.
    """
    return _decided(docs, threshold, words, count, rows).select("doc_id", "class_id", "kept")


def _decided(docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As near_duplicates; where ids repeat, with the digest of each row's text. A written table; what led to it is deleted."""
    with only_last(docs.sparkSession):
        return _decide(docs, threshold, words, count, rows)


def _decide(docs: DataFrame, threshold: float, words: int, count: int, rows: int) -> DataFrame:
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    base = docs.select(own_id.alias("doc_id"), "text")
    sign = lambda rows_in: written(rows_in.mapInArrow(_signer(words, count, rows), "doc_id long, key binary, weight long, bands array<long>"), "dup-signed")
    signed = sign(base)
    repeats = not signed.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeats:
        keyed = _row_keys(base)
        base = keyed.select(F.col("key").alias("doc_id"), "text")
        signed = sign(base)

    copies = written(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "dup-copies")
    mapped = written(attach(signed.select("doc_id", "key"), copies, ["key"], "doc_id").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "dup-mapped")
    nodes = attach(signed, copies, ["key"], "doc_id").filter(F.coalesce("rep", "doc_id") == F.col("doc_id"))
    members = written(nodes.select(F.col("doc_id").alias("id"), "weight", F.explode("bands").alias("band")), "dup-members")
    buckets = written(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "dup-buckets")
    shared = written(attach(members, buckets, ["band"], "id", counts=buckets).filter("n is not null"), "dup-shared")

    central = shared.groupBy("id").agg(F.sum("n").alias("c"))
    leaders = shared.join(central, "id").groupBy("band").agg(F.max(F.struct("c", "id", "weight")).alias("l")).select("band", F.col("l.id").alias("leader"), F.col("l.weight").alias("lw"))
    leaders = written(leaders, "dup-leaders")
    close = F.least("weight", "lw") >= threshold * F.greatest("weight", "lw") - 1e-9
    pairs = written(attach(shared, leaders, ["band"], "id", counts=buckets).filter((F.col("id") != F.col("leader")) & close).select("id", "leader").distinct(), "dup-pairs")

    needed = written(shared.select(F.col("id").alias("doc_id")).distinct(), "dup-needed")
    few = needed.limit(PICKED_IDS + 1).count() <= PICKED_IDS
    texts = base.join(F.broadcast(needed) if few else needed, "doc_id", "left_semi")
    sets = written(texts.mapInArrow(_cell_lists(words), "id long, cells array<long>"), "dup-sets")
    led = sets.join(pairs.select(F.col("leader").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("leader"), F.col("cells").alias("others"))
    both = attach(pairs, written(led, "dup-led"), ["leader"], "id", wide=True).join(sets, "id")
    common = F.size(F.array_intersect("cells", "others"))
    links = written(both.filter(common / (F.size("cells") + F.size("others") - common) >= threshold).select(F.col("id").alias("a"), F.col("leader").alias("b")), "dup-links")
    classes = written(connected(links), "dup-classes")

    placed = written(shared.join(classes, "id", "left").select("band", "id", "n", F.coalesce("comp", "id").alias("comp")), "dup-placed")
    mixed = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo < hi and size > 2").select("band", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = attach(placed, written(mixed, "dup-mixed"), ["band"], "id", counts=buckets).filter("blocks is not null").withColumn("k", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "id", "comp", F.least("k", "j").alias("i"), F.greatest("k", "j").alias("j")).join(sets, "id")
    more = written(dealt.groupBy("band", "i", "j").applyInArrow(_compare(threshold), "a long, b long").distinct(), "dup-more")
    if not more.isEmpty():
        classes = written(connected(links.unionByName(more)), "dup-all-classes")
    final = attach(mapped, classes.withColumnRenamed("id", "rep"), ["rep"], "doc_id")
    final = written(final.select("doc_id", F.coalesce("comp", "rep").alias("class_id")), "dup-result")
    null = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    if not repeats:
        return final.select(null("doc_id"), null("class_id"), (F.col("doc_id") == F.col("class_id")).alias("kept"))
    of_keys = keyed.select("doc_id", "digest", "extra", "key").join(final.select(F.col("doc_id").alias("key"), F.col("class_id").alias("comp")), "key")
    of_keys = written(of_keys, "dup-of-keys")
    named = written(of_keys.groupBy("comp").agg(F.min(F.struct("extra", "key")).alias("b")).select("comp", F.col("b.key").alias("class_id")), "dup-named")
    of_rows = attach(of_keys, named, ["comp"], "key").select(F.col("doc_id").alias("id"), "digest", "class_id", (F.col("key") == F.col("class_id")).alias("kept"))
    each = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_id.alias("id"), _digest().alias("digest"), F.monotonically_increasing_id().alias("place")), "dup-each")
    return written(attach(each, written(of_rows, "dup-of-rows"), ["id", "digest"], "place").select("doc_id", "digest", null("class_id"), "kept"), "dup-rows")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each class: the one that names it. All columns are kept, whatever their names."""
    classes = _decided(docs, threshold)
    gone = classes.filter(~F.col("kept"))
    plain, back = renamed(docs)
    own_id, text = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    if "digest" not in classes.columns:
        gone = gone.select(F.col("doc_id").alias("gone"))
        few = gone.limit(PICKED_IDS + 1).count() <= PICKED_IDS
        return back(plain.join(F.broadcast(gone) if few else gone, own_id.eqNullSafe(F.col("gone")), "left_anti"))
    gone = written(gone.select(F.col("doc_id").alias("gone"), F.col("digest").alias("gone_digest")).distinct(), "dup-gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = plain.withColumn("digest", _digest(text)).withColumn("number", own_id.cast("long"))
    same = F.col("number").eqNullSafe(F.col("gone")) & (F.col("digest") == F.col("gone_digest"))
    return back(marked.join(F.broadcast(gone) if few else gone, same, "left_anti").dropDuplicates(["number", "digest"]))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
