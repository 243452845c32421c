"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a budget of words (weights, a total share, a cap of two times its size with the excess shared again).
Which documents fill it is decided by a fixed hash of the id: sums of sizes by (source, hash bucket) give the bucket in
which the budget ends, only that bucket is split further, and the result is one hash threshold per source, so that a
smaller budget always takes a subset of a larger one and no document is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagmask.llm.common import attach, read, renamed, written

#: A word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash (15 hexadecimal digits of MD5), and bits that one histogram level resolves.
HASH_BITS, LEVEL_BITS = 60, 10


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column, text: Column, salt: str = "mix:") -> Column:
    """60 bits of MD5 over the salted id, as long; rows without an id go by their text."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """(source, source_size) -> plus target. Water filling: caps at max_repeat x size, excess shared by weight again."""
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    dim = written(ranked.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * max_repeat).cast("double").alias("cap")), "mix-sources")
    total = share * (dim.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(level)
        used, free = dim.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free:
            level = float("inf")
            break
        new = (total - (used or 0.0)) / free
        if new <= level:
            break
        level = new
    target = F.col("cap") if level == float("inf") else F.least("cap", F.col("weight") * F.lit(level))
    return dim.select("source", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """(source, size, h) -> one row per source: source_size, target, whole (copies of every document) and threshold.

    A document is taken once more if its hash lies under the threshold (null: always) and `whole` is under `max_repeat`.
    """
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(0).cast("long")
    rest = F.when(F.col("whole") >= max_repeat, 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))
    budgets = written(targets.withColumn("whole", whole).withColumn("rest", rest), "mix-budgets")

    # Level by level: the bucket of each source in which its budget ends; (rest) is what the buckets before it leave.
    open_rows, left, done = sized, budgets.select("source", "rest"), None
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucketed = open_rows.withColumn("b", F.shiftright("h", shift))
        sums = bucketed.groupBy("source", "b").agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = attach(sums, left, ["source"], "b").withColumn("upto", F.sum("n").over(before))
        ends = filled.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("b", "lo", "hi", "n", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest")), "b").alias("e")).select("source", "e.*")
        ends = written(ends, f"mix-level{shift}")
        single = ends.filter(F.col("lo") == F.col("hi"))
        threshold = single.select("source", F.when(F.col("n") - F.col("rest") <= F.col("rest"), F.col("lo") + 1).otherwise(F.col("lo")).alias("threshold"))
        done = threshold if done is None else done.unionByName(threshold)
        ends = ends.filter(F.col("lo") < F.col("hi"))
        if ends.isEmpty():
            break
        boundary = attach(bucketed, ends.select("source", F.col("b").alias("_eb")), ["source"], "h").filter(F.col("b") == F.col("_eb"))
        open_rows = written(boundary.select("source", "size", "h"), f"mix-open{shift}")
        left = ends.select("source", "rest")
    return written(attach(budgets, done, ["source"], "source"), "mix-thresholds")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(id_col), F.col(text_col)).alias("h")), "mix-sizes")


def _copies(max_repeat: int) -> Column:
    extra = (F.col("whole") < max_repeat) & (F.col("threshold").isNull() | (F.col("h") < F.col("threshold")))
    return (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document is taken so that every source comes near its target.

    Returns one row per input row: doc_id, source, size, source_size, target, copies (0..max_repeat), taken = size * copies.
    Sources in code-point order, null last as a source of its own, get `weights` in rotation. A target of t words of a
    source with S words takes every document floor(t / S) times; the rest goes once more to the documents whose hash lies
    under the source's threshold, the document at the threshold only if that brings the sum nearer to the target.
    Null or empty texts have size 0, take part and take nothing. Rows with equal ids share a hash and are in or out
    together; rows without an id go by their text. Other columns are ignored; an empty table gives an empty result.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    mixed = attach(sized, mix_plan(sized, weights, share, max_repeat), ["source"], "h").withColumn("copies", _copies(max_repeat))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """The mix itself: every row of `docs` (doc_id, text, source, ...) as often as it is taken, all columns kept, whatever their names.

    Only the plan (one row per source) is joined to the documents; no text is shuffled.
    """
    plan = mix_plan(_sized(docs, "doc_id", "text", "source"), weights, share, max_repeat).select("source", "whole", "threshold")
    plain, back = renamed(docs)
    own = {n: F.col(f"c{i}") for i, n in enumerate(docs.columns)}
    marked = plain.withColumns({"source": own["source"], "h": row_hash(own["doc_id"], own["text"])})
    taken = attach(marked, plan, ["source"], "h").withColumn("copy", F.explode(F.array_repeat(F.lit(1), _copies(max_repeat).cast("int"))))
    return back(taken)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of each."""
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) * 2 AS DOUBLE) AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
filling AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
         - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
found AS (SELECT level FROM filling WHERE cap / weight > level ORDER BY cap / weight, source LIMIT 1),
budgets AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM found), 'infinity'::DOUBLE)) AS target FROM sources),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS whole FROM budgets),
rests AS (SELECT *, CASE WHEN whole >= 2 THEN 0.0 ELSE target - whole * source_size END AS rest FROM parts),
placed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS n
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source),
decided AS (
  SELECT *, whole + CASE WHEN whole < 2 AND (upto <= rest OR (upto - n <= rest AND upto - rest <= rest - (upto - n))) THEN 1 ELSE 0 END AS copies
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM decided
"""
