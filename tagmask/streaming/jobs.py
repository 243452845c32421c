"""Incremental runs: detection and numbering per micro-batch, masking and restoring as streams, running totals.

Here a batch reads the tables of earlier ones; keyed.py keeps state per dossier instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tagmask.operators.masking import assign_tags, claimed_tags, count_occurrences, mask_text, new_values, pending_documents, spellings
from tagmask.operators.restore import restore
from tagmask.sources.scratch import passing, shuffles_go


def incoming(spark: SparkSession, rows: DataFrame, path: str, batches: int = 3) -> DataFrame:
    """Rows, written under `path`/in, as a stream of so many micro-batches, each of as many files as there are cores."""
    each = spark.sparkContext.defaultParallelism
    with shuffles_go(spark):
        rows.repartition(batches * each).write.option("compression", "zstd").parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{path}/in")


def stream_analyse(docs: DataFrame, detector: Callable[[DataFrame], DataFrame], state_path: str, checkpoint: str) -> StreamingQuery:
    """New documents are detected once; tags grow and are never numbered again; counts follow all documents so far.

    State lies in batch folders under `state_path` (documents, tags, counts); a batch that is run again overwrites its
    own folder and reads only earlier ones, so its result is the same. A batch counts the dossiers that it touches, over all
    their documents, as new values may claim text in old ones. See stream_tags for the table.
    """
    spark = docs.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        def earlier(name: str) -> DataFrame | None:
            path = f"{state_path}/{name}"
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
                return None
            return spark.read.parquet(path).filter(F.col("batch") < batch_id).drop("batch")

        def kept(name: str, rows: DataFrame) -> DataFrame:
            with shuffles_go(spark):
                rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{state_path}/{name}/batch={batch_id}")
            return spark.read.schema(rows.schema).parquet(f"{state_path}/{name}/batch={batch_id}")

        seen, tags = earlier("documents"), earlier("tags")
        first = F.row_number().over(Window.partitionBy("dossier_id", "doc_id").orderBy("arrival", "text"))
        batch = batch.withColumn("_r", first).filter("_r = 1").drop("_r")
        fresh = kept("documents", batch if seen is None else pending_documents(batch, seen.select("dossier_id", "doc_id")))
        counters = None if tags is None else tags.groupBy("dossier_id", "category").agg(F.max("idx").alias("last_idx"))
        new = kept("tags", assign_tags(new_values(detector(fresh), tags), counters, tags))
        touched = fresh.select("dossier_id").distinct()
        table = (new if tags is None else tags.unionByName(new)).join(touched, "dossier_id", "left_semi")
        texts = (fresh if seen is None else seen.unionByName(fresh)).join(touched, "dossier_id", "left_semi")
        with passing(spark):
            kept("counts", count_occurrences(table, claimed_tags(texts, spellings(table))).select("dossier_id", "tag", "occurrences", "status"))

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_tags(spark: SparkSession, state_path: str) -> DataFrame:
    """The tag table of a stream_analyse run so far, each dossier's counts from the last batch that touched it."""
    counts = spark.read.parquet(f"{state_path}/counts")
    last = counts.groupBy("dossier_id", "tag").agg(F.max_by(F.struct("occurrences", "status"), "batch").alias("c"))
    tags = spark.read.parquet(f"{state_path}/tags").drop("batch", "occurrences", "status")
    return tags.join(last, ["dossier_id", "tag"]).select(*tags.columns, "c.occurrences", "c.status")


def stream_mask(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """A stream of documents masked with the tags there are."""
    return mask_text(docs, spellings(tags))


def stream_restore(answers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """A stream of returned texts, each restored or refused."""
    return restore(answers, dictionary)


def stream_usage(usage: DataFrame) -> DataFrame:
    """Running tokens and calls per session (update mode)."""
    return usage.groupBy("session_id").agg(F.sum("token_in").alias("token_in"), F.sum("token_out").alias("token_out"), F.count("*").alias("calls"))
