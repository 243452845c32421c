"""Toxicity score: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features per document: densities of a lexicon learnt from the labels (whole words, and word beginnings for inflected
forms), nearness of second-person words to lexicon words, rates of capitals, punctuation and obfuscation. The trees and
the calibration are Spark ML models fitted on a bounded sample of the labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.llm.common import read, renamed, written
from tagmask.llm.language_id import held_out
from tagmask.llm.vector_text import LETTER, Block, Hashes, as_text, blocks, light, mix

if TYPE_CHECKING:  # Spark ML is imported where models are used: tasks need only the features
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import IsotonicRegressionModel

#: Bounded training sample of labelled rows, and lexicon entries kept (documented bounds; ids with the smallest hashes).
TRAIN_ROWS, LEXICON = 20_000, 1000
#: Lengths in bytes of word beginnings that the lexicon may hold.
BEGINNINGS = (4, 5, 6)
#: Words between a second-person word and a lexicon word that count as near.
NEAR = 5
#: Second-person words of the covered languages.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "usted", "ustedes", "vosotros", "ti", "tus", "vuestro")
FEATURES = ("hits", "word_density", "begin_density", "second_density", "second_near", "capitals", "shouted", "punctuation", "exclaiming", "obfuscated", "digits", "log_words")

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LOUD = np.zeros(256, bool)
_LOUD[[ord("!"), ord("?")]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
#: Bytes that stand for letters inside obfuscated words.
_MASKING = np.zeros(256, bool)
_MASKING[[ord(c) for c in "*@$#%0123456789"]] = True


def _word_hash(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.unique(Hashes(data).of(ends - [len(w.encode()) for w in words], ends))


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, documents and hashes of all words of a lower-cased block, and hashes of their beginnings (0: too short)."""
    starts, ends = block.words()
    hashes = block.hashes()
    begins = []
    for n in BEGINNINGS:
        longer = ends - starts > n
        begin = np.zeros(len(starts), np.uint64)
        begin[longer] = hashes.of(starts[longer], starts[longer] + n, seed=n)
        begins.append(begin)
    return starts, block.doc_of(starts), hashes.of(starts, ends), begins


class Lookup:
    """Membership in a small set of hashes, with a bitmap in front."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.unique(entries)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.entries >> np.uint64(48)).astype(np.int64)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        found = self.bits[(values >> np.uint64(48)).astype(np.int64)]
        if len(self.entries):
            some = np.flatnonzero(found)
            found[some] = np.isin(values[some], self.entries)
        return found


@dataclass
class Lexicon:
    words: np.ndarray
    begins: np.ndarray

    def features(self, original: pa.Array) -> np.ndarray:
        """Rows of FEATURES for a column of texts."""
        words, begins, second = Lookup(self.words), Lookup(self.begins), Lookup(_word_hash(SECOND_PERSON))
        lowered, out = as_text(original, lower=True), [np.zeros((0, len(FEATURES)))]
        for block in blocks(lowered):
            starts, doc, word, begin = tokens(block)
            n = block.docs
            count = lambda mask, by=doc, n=n: np.bincount(by[mask], minlength=n)[:n].astype(float)
            is_word = words.has(word)
            is_begin = np.zeros(len(word), bool)
            for b in begin:
                is_begin |= begins.has(b)
            hit = is_word | is_begin
            you = np.flatnonzero(second.has(word))
            at = np.flatnonzero(hit)
            near = np.zeros(len(word), bool)
            if len(you) and len(at):
                right = np.searchsorted(you, at)
                for side in (np.clip(right, 0, len(you) - 1), np.clip(right - 1, 0, len(you) - 1)):
                    near[at] |= (np.abs(you[side] - at) <= NEAR) & (doc[you[side]] == doc[at])
            total = np.maximum(1.0, np.bincount(doc, minlength=n)[:n])
            size = np.maximum(1.0, np.diff(block.offsets))
            letter = block.kinds >= LETTER
            inside = _MASKING[block.data] & block.before(letter) & block.after(letter)
            out.append(np.stack([count(hit), count(is_word) / total, count(is_begin) / total, count(second.has(word)) / total, count(near), np.zeros(n), np.zeros(n), block.per_doc(_PUNCT[block.data]) / size, block.per_doc(_LOUD[block.data]) / total, block.per_doc(inside) / total, block.per_doc(_DIGIT[block.data]) / size, np.log1p(np.bincount(doc, minlength=n)[:n])], 1))
        features, place = np.concatenate(out), 0
        for block in blocks(as_text(original)):
            upper = _UPPER[block.data]
            letters = np.maximum(1.0, block.per_doc((block.kinds >= LETTER) & (block.data & 0xC0 != 0x80)))
            features[place : place + block.docs, 5] = block.per_doc(upper) / letters
            features[place : place + block.docs, 6] = block.per_doc(upper & block.before(upper)) / letters
            place += block.docs
        return features


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each token by class, summed inside a batch: (kind 0 word or 1 beginning, token, clean, toxic)."""
    for batch in light(batches):
        label = np.asarray(batch.column("label"))
        for block in blocks(as_text(batch.column("text"), lower=True)):
            _, doc, word, begin = tokens(block)
            for kind, columns in ((0, [word]), (1, begin)):
                for token in columns:
                    key = mix(token) ^ mix(doc, 5)
                    _, once = np.unique(key[token != 0], return_index=True)
                    t, d = token[token != 0][once], doc[token != 0][once]
                    toxic = label[block.first + d]
                    u, inverse = np.unique(t, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(np.bincount(inverse, 1 - toxic, len(u)).astype(np.int64)), pa.array(np.bincount(inverse, toxic, len(u)).astype(np.int64))], ["kind", "token", "clean", "toxic"])


def learn_lexicon(sample: DataFrame, kept: int = LEXICON) -> Lexicon:
    """Tokens far commoner in toxic texts than chance allows: log-likelihood ratio above a bound that grows with the vocabulary."""
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    counts = sample.select("text", "label").mapInArrow(_token_counts, "kind int, token long, clean long, toxic long")
    counts = written(counts.groupBy("kind", "token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tox-tokens")
    least = 2 * math.log(max(2, counts.count())) + 6
    base = toxic / (clean + toxic)
    n, k = F.col("clean") + F.col("toxic"), F.col("toxic")
    ratio = 2 * (F.when(k > 0, k * F.log(k / (n * base))).otherwise(0) + F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - base)))).otherwise(0))
    # A beginning must name toxic texts almost alone, or it would only echo the share of one of its words.
    rows = counts.withColumn("ratio", ratio).filter((F.col("ratio") >= least) & (k / n >= 0.8)).orderBy(F.col("ratio").desc(), "kind", "token").limit(kept).collect()
    pick = lambda kind: np.array([r.token for r in rows if r.kind == kind], np.int64).view(np.uint64)
    return Lexicon(pick(0), pick(1))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float

    def score(self, docs: DataFrame) -> DataFrame:
        """All columns of `docs` plus toxicity (0 to 1) and predicted (1 if toxicity >= 0.5).

        Own columns of these two names are replaced; all others stay, whatever their names. One row per row: equal texts
        have equal scores, repeated rows stay, null texts count as empty, long texts are read whole, an empty table stays so.
        """
        from pyspark.ml.functions import vector_to_array

        own = docs.drop("toxicity", "predicted")
        plain, _ = renamed(own)
        if self.trees is None:
            score = F.lit(float(self.base))
            scored = plain
        else:
            margin = self.trees.transform(_assembled(_with_features(plain, self.lexicon, f"c{own.columns.index('text')}")))
            margin = margin.withColumn("_margin", vector_to_array("rawPrediction")[1]).drop("prediction")
            scored = self.calibration.transform(margin)
            score = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        scored = scored.select(*plain.columns, score.alias("toxicity")).withColumn("predicted", F.when(F.col("toxicity") >= 0.5, 1).otherwise(0))
        return scored.toDF(*own.columns, "toxicity", "predicted")


def _with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text", drop_text: bool = False) -> DataFrame:
    own = [c for c in docs.columns if not (drop_text and c == text)]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches, text):
            values = shared.value.features(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(FEATURES)))], [*own, *(f"_f_{n}" for n in FEATURES)])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(compute, ", ".join([*(f"`{c}` {kinds[c]}" for c in own), *(f"_f_{n} double" for n in FEATURES)]))


def _assembled(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[f"_f_{n}" for n in FEATURES], outputCol="_features").transform(df)


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 3) -> ToxicityModel:
    """Fit on (doc_id, text) and labels (doc_id, toxic 0/1); only the text is an input of the score.

    At most about `train_rows` labelled rows are used, chosen by a hash of the id; their whole texts are read once. A
    third of them calibrates, the rest grows trees. Null labels or ids teach nothing, an id labelled twice counts as its
    larger label. With one class or no labelled text the score is the smoothed base rate.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    share = train_rows / max(1, known.count())
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # `picked` has about train_rows rows at any size of the input: small enough to broadcast, so no text is shuffled.
    sample = written(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0), "tox-sample")
    classes = {(r.label, r.calibrate): r.n for r in sample.groupBy("label", "calibrate").agg(F.count("*").alias("n")).collect()}
    toxic, total = sum(n for (label, _), n in classes.items() if label), sum(classes.values())
    lexicon = learn_lexicon(sample)
    if any(not classes.get((label, part)) for label in (0, 1) for part in (False, True)):
        return ToxicityModel(lexicon, None, None, (toxic + 0.5) / (total + 1))
    rows = _assembled(written(_with_features(sample, lexicon, drop_text=True).coalesce(4), "tox-features"))
    model = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=1, minInstancesPerNode=5).fit(rows.filter(~F.col("calibrate")))
    margin = model.transform(rows.filter("calibrate")).withColumn("_margin", vector_to_array("rawPrediction")[1]).drop("prediction")
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="label").fit(margin.withColumn("label", F.col("label").cast("double")))
    return ToxicityModel(lexicon, model, calibration, toxic / total)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from labels that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(~held_out(F.col("doc_id"), 5, 0)))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("toxicity").alias("score"), "predicted")
