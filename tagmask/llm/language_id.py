"""Language identification by bit-sliced Bloom filters of character n-grams.

Training keeps, per language, the n-grams that occur most often; all languages go into one Bloom filter whose slots are
bit masks of languages, so that one lookup (an AND over the hash slots) returns every language that has the n-gram.
A text's n-grams are looked up, hits are counted per language, corrected for the false positives that the fill of a
language's bit slice implies, and the language with the highest corrected hits wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagmask.llm.common import attach, read, written
from tagmask.llm.vector_text import LETTER, Block, as_text, blocks, light, mix

#: Lengths of n-grams in bytes of lower-cased text in which every run of other than letters is one blank.
SIZES = (3, 4)
#: Bounded training sample: documents per language (the ids with the smallest hashes), n-grams kept per language.
TRAIN_DOCS, KEPT = 3000, 600
#: Slots of the filter and hash functions.
SLOTS, HASHES = 1 << 17, 3
UNKNOWN = "und"


def grams(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of all n-grams of `size` (at most 7) bytes; a code holds the bytes and the size."""
    letter = block.kinds >= LETTER
    kept = letter | block.before(letter)
    data = np.where(letter, block.data, 32)[kept].astype(np.uint64)
    places = np.concatenate([[0], np.cumsum(kept)])[block.offsets]
    if len(data) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(data) - size + 1
    code = np.full(n, size, np.uint64)
    for i in range(size):
        code = (code << np.uint64(8)) | data[i : i + n]
    doc = np.repeat(np.arange(block.docs), np.diff(places))
    whole = doc[:n] == doc[size - 1 :]
    return code[whole], doc[:n][whole]


@dataclass
class LanguageFilter:
    """The trained filter: masks[slot, word] over languages (64 to a word) and each language's false positive rate."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    sizes: tuple[int, ...]
    hashes: int

    @staticmethod
    def of(languages: list[str], codes: np.ndarray, language: np.ndarray, sizes=SIZES, slots: int = SLOTS, hashes: int = HASHES) -> LanguageFilter:
        masks = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        for k in range(hashes):
            slot = (mix(codes, k) % np.uint64(slots)).astype(np.int64)
            np.bitwise_or.at(masks, (slot, language // 64), np.uint64(1) << (language % 64).astype(np.uint64))
        fill = np.array([np.mean((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
        return LanguageFilter(languages, masks, fill**hashes, tuple(sizes), hashes)

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages: corrected hits, n-grams of each document)."""
        found, total = np.zeros((block.docs, len(self.languages))), np.zeros(block.docs)
        for size in self.sizes:
            codes, doc = grams(block, size)
            total += np.bincount(doc, minlength=block.docs)
            slots = [(mix(codes, k) % np.uint64(len(self.masks))).astype(np.int64) for k in range(self.hashes)]
            for word in range(self.masks.shape[1]):
                mask = self.masks[slots[0], word]
                for slot in slots[1:]:
                    mask = mask & self.masks[slot, word]
                for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    found[:, i] += np.bincount(doc, (mask >> np.uint64(i % 64)) & np.uint64(1), block.docs)
        return np.maximum(0, (found - total[:, None] * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate)), total

    def judge(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and share of known n-grams of every text. Ties go to the language first by name."""
        if not self.languages:
            return [UNKNOWN] * len(text), np.zeros(len(text)), np.zeros(len(text))
        hits, total = map(np.concatenate, zip(*(self.hits(b) for b in blocks(text)), strict=True))
        best, known = hits.argmax(1), hits.max(1) if len(hits) else np.zeros(0)
        score = np.divide(known, hits.sum(1), out=np.zeros(len(hits)), where=hits.sum(1) > 0)
        return [self.languages[i] for i in best], score, np.divide(known, total, out=np.zeros(len(hits)), where=total > 0)


def _gram_counts(sizes: tuple[int, ...]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches):
            langs = batch.column("lang").dictionary_encode()
            of_row = np.asarray(langs.indices)
            for block in blocks(as_text(batch.column("text"), lower=True)):
                for size in sizes:
                    codes, doc = grams(block, size)
                    lang = of_row[block.first + doc]
                    for i in np.unique(lang):
                        code, n = np.unique(codes[lang == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[int(i)].as_py()] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    return count


def train_languages(docs: DataFrame, train_docs: int = TRAIN_DOCS, kept: int = KEPT, sizes: tuple[int, ...] = SIZES) -> LanguageFilter:
    """Learn the filter from (doc_id, text, lang); rows without text or lang teach nothing.

    At most about `train_docs` documents per language are read (a documented bound; chosen by a hash of the id, whole
    texts), and at most `kept` n-grams of each language and size come to the driver.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = written(usable.groupBy("lang").count().select("lang", (F.lit(train_docs * 1_000_000) / F.col("count")).alias("share")), "lang-shares")
    picked = attach(usable.select("doc_id", "text", "lang"), share, ["lang"], "doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share"))
    counts = picked.select("text", "lang").mapInArrow(_gram_counts(sizes), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", F.floor(F.log2("code") / 8)).orderBy(F.col("n").desc(), "code")
    rows = counts.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= kept).select("lang", "code").collect()
    names = sorted({r.lang for r in rows})
    place = {name: i for i, name in enumerate(names)}
    return LanguageFilter.of(names, np.array([r.code for r in rows], np.uint64), np.array([place[r.lang] for r in rows], np.int64), sizes)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """All columns of `docs` plus lang_pred, lang_score (share of the winner's hits among all languages') and lang_known
    (share of the text's n-grams that the winner knows). `und` with score 0 where the text is null or has no letter.
    Column names that clash are replaced. Repeated texts get equal values, very long ones are read whole, an empty table
    stays so. Equal counts of several languages go to the first by name."""
    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_known")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches):
            texts = as_text(batch.column("text"), lower=True)
            letters = pc.match_substring_regex(texts, r"\pL")
            lang, score, known = shared.value.judge(texts)
            lang = pc.if_else(letters, pa.array(lang, pa.string()), UNKNOWN)
            has = np.asarray(letters)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), lang, pa.array(score * has), pa.array(known * has)], [*own, "lang_pred", "lang_score", "lang_known"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return docs.select(*own).mapInArrow(judge, f"{fields}, lang_pred string, lang_score double, lang_known double")


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod `of` is `rest`; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == rest


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = train_languages(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    judged = identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_known").alias("known"))
