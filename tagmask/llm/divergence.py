"""Divergence of the sources of a language, term by term.

Texts become partial counts inside Arrow batches (lower-cased, split, dictionary-encoded, hash-grouped); Spark adds them up.
Kept terms are dealt into columnar shards of a language: a shard is a matrix of sources by terms, from which smoothed
probabilities, their distances for every pair of sources and the terms that mark a source follow. Distances of shards add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagmask.llm.common import attach, read, written
from tagmask.llm.decontaminate import split_words
from tagmask.llm.vector_text import as_text, light

#: What lies between terms of lower-cased text.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term needs, smoothing, unit of the probabilities, and ranks of terms that are reported.
LEAST_DOCS, SMOOTHING, UNIT, TERM_RANKS = 30, 5, 1_000_000_000, 50
#: Partial counts that a task gathers before it hands them on, and cells of one shard's matrix.
GATHERED, CELLS = 300_000, 1_000_000


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the batches, gathered over several of them."""
    names, keys = ["lang", "source", "term", "n", "docs"], ["lang", "source", "term"]
    gathered: list[pa.Table] = []

    def together() -> pa.Table:
        summed = pa.concat_tables(gathered).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return summed.select([*keys, "n_sum", "docs_sum"]).rename_columns(names)

    for batch in light(batches):
        lang, source = (as_text(batch.column(c)).dictionary_encode() for c in ("lang", "source"))
        words, rows = split_words(batch.column("text"), BETWEEN)
        coded = words.dictionary_encode()
        per_doc = pa.table({"doc": rows, "t": coded.indices}).group_by(["doc", "t"]).aggregate([([], "count_all")])
        doc = per_doc["doc"].combine_chunks()
        grouped = pa.table({"l": lang.indices.take(doc), "s": source.indices.take(doc), "t": per_doc["t"], "n": per_doc["count_all"]})
        counts = grouped.group_by(["l", "s", "t"]).aggregate([("n", "sum"), ("n", "count")])
        decoded = [d.take(counts[c].combine_chunks()).cast(pa.string()) for d, c in ((lang.dictionary, "l"), (source.dictionary, "s"), (coded.dictionary, "t"))]
        gathered.append(pa.table([*decoded, counts["n_sum"], counts["n_count"]], names))
        if sum(t.num_rows for t in gathered) > GATHERED:
            gathered = [together()]
            if gathered[0].num_rows > GATHERED // 2:
                yield from gathered[0].to_batches()
                gathered = []
    if gathered:
        yield from together().to_batches()


def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * part / whole), exact in 64 bits for part <= whole < 9e15: a long division, three digits at a time."""
    digits, rest = part // whole, part % whole
    for _ in range(3):
        digits, rest = digits * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return digits + 1


def _shard(smoothing: int, ranks: int):
    def diverge(terms: pa.Table, sources: pa.Table) -> pa.Table:
        """All sources of one language against one shard of its terms (lang, bucket, term, total, counts)."""
        terms, sources = terms.sort_by("term"), sources.sort_by("source")
        names, term = sources["source"].combine_chunks(), terms["term"].combine_chunks()
        lang, k, n = sources["lang"][0].as_py(), len(names), len(term)
        size, kinds, whole = (np.asarray(sources[c], np.int64) for c in ("n", "v", "lang_n"))
        listed = terms["counts"].combine_chunks()
        counts = np.zeros((k, n), np.int64)
        if n:
            flat = listed.flatten()
            counts[np.asarray(pc.index_in(flat.field("source"), names)), np.asarray(pc.list_parent_indices(listed))] = np.asarray(flat.field("n"))
            p = ratio(counts + smoothing, (size + smoothing * kinds)[:, None])
            q = ratio(np.asarray(terms["total"], np.int64) + smoothing, np.full(n, whole[0] + smoothing * kinds[0]))
        else:
            p, q = counts, np.zeros(0, np.int64)
        out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

        def add(source: str, part: str, items: pa.Array, values: np.ndarray) -> None:
            out["source"].append(pa.repeat(pa.scalar(source, pa.string()), len(items)))
            out["part"].append(pa.repeat(pa.scalar(part, pa.string()), len(items)))
            out["item"].append(items.cast(pa.string()))
            out["value"].append(pa.array(values, pa.int64()))

        for i, source in enumerate(names.to_pylist()):
            others = np.flatnonzero(np.arange(k) != i)
            add(source, "pair", names.take(pa.array(others)), np.abs(p - p[i]).sum(1)[others])
            marked = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            # Terms are in UTF-8 order, so a stable sort by value breaks ties as the ranks do.
            best = marked[np.argsort(q[marked] - p[i, marked], kind="stable")[:ranks]]
            add(source, "term", term.take(pa.array(best)), (p[i] - q)[best])
        columns = {c: pa.chunked_array(a).combine_chunks() for c, a in out.items()}
        return pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(columns["item"])), **columns})

    return diverge


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents of the group with the term). Null lang, source and text are ''."""
    fields = "lang string, source string, term string, n long, docs long"
    return docs.select("text", "lang", "source").mapInArrow(_partial_counts, fields).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, smoothing: int = SMOOTHING, ranks: int = TERM_RANKS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank of (text, lang, source).

    Part `pair`: every other source of the language, value the sum over the language's kept terms of the distances of both
    sources' smoothed probabilities; part `term`: the `ranks` terms that are likelier in the source than in the language, by
    how much. Kept terms occur in `least_docs` documents of the language. Ranks go by value falling, then item in UTF-8.

    Null lang, source or text count as ''. Every occurring group is there, even one without terms (its probabilities are
    those of no occurrence); a language of one source has no pairs, an empty table no rows. Repeated rows count each. Other
    columns are ignored. A shard holds about `cells` counts, whatever a language's sources and terms are.
    """
    counts = written(term_counts(docs), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = written(kept.filter(F.col("_docs") >= least_docs).drop("_docs"), "term-kept")
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("_k")).join(langs, "lang", "left")
    fill = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    per_lang = written(per_lang.select("lang", fill("v"), fill("lang_n"), F.ceil((F.col("_k") * F.coalesce("v", F.lit(0)) + 1) / cells).cast("int").alias("buckets")), "term-langs")
    sizes = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    sources = groups.join(sizes, ["lang", "source"], "left").join(per_lang, "lang").select("lang", "source", fill("n"), "v", "lang_n", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    dealt = attach(kept, per_lang.select("lang", "buckets"), ["lang"], "term").select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "term", "total", "counts")
    key = ["lang", "bucket"]
    shards = dealt.groupBy(*key).cogroup(sources.groupBy(*key)).applyInArrow(_shard(smoothing, ranks), "lang string, source string, part string, item string, value long")
    values = shards.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = values.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= ranks))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of every language of all documents against each other and their language."""
    return source_divergence(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
