"""Documents coming in and going out: files, pages, and their verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tagmask.functions.text import clean_filename, is_blank, masked_filename
from tagmask.model import MAX_BYTES, MAX_DOCUMENTS, MAX_IMAGE_SHARE, MIN_CHARS


#: Bytes of contents, or of names, that go to Spark at once.
_BATCH_BYTES = 8 * 1024 * 1024


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a folder, hidden ones (`_`, `.`) left out. The driver lists directories only to find more of
    them, level by level; files are listed in tasks, so however many there are, none is kept on the driver."""
    files = pa.schema([("path", pa.string()), ("length", pa.int64())])
    prefix = path if "://" in path else ""

    def below(batches: Iterator[pa.RecordBatch], kind: fs.FileType) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                for folder in batch.column("path").to_pylist():
                    store, inner = fs.FileSystem.from_uri(prefix) if prefix else (fs.LocalFileSystem(), None)
                    for info in store.get_file_info(fs.FileSelector(folder)):
                        if info.type == kind and not info.base_name.startswith(("_", ".")):
                            yield info.path, info.size or 0

        return _batches(found(), files, lambda row: len(row[0]))

    root = fs.FileSystem.from_uri(prefix)[1] if prefix else path
    dealt = lambda folders: spark.createDataFrame([(f,) for f in folders], "path string").repartition(max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism)))
    folders, level = [root], [root]
    while level:
        level = [r.path for r in dealt(level).mapInArrow(partial(below, kind=fs.FileType.Directory), "path string, length long").toLocalIterator()]
        folders += level
    return dealt(folders).mapInArrow(partial(below, kind=fs.FileType.File), "path string, length long").withColumn("prefix", F.lit(prefix))


def read_files(files: DataFrame) -> DataFrame:
    """`files` (path, length, prefix) plus `content`, read where the task is, some megabytes at a time."""
    out = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def contents() -> Iterator[tuple]:
            stores: dict[str, fs.FileSystem] = {}
            for batch in batches:
                for path, length, prefix in zip(*(batch.column(n).to_pylist() for n in ("path", "length", "prefix")), strict=True):
                    if prefix not in stores:
                        stores[prefix] = fs.FileSystem.from_uri(prefix)[0] if prefix else fs.LocalFileSystem()
                    with stores[prefix].open_input_file(path) as file:
                        yield path, length, file.read()

        return _batches(contents(), out, lambda row: len(row[2]) + len(row[0]))

    return files.select("path", "length", "prefix").mapInArrow(read, "path string, length long, content binary")


def read_raw_documents(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """One file, one document; the directory is the dossier. Columns dossier_id, filename, length, content. Files over `cap` bytes
    are left out before they are read. Listing and reading are dealt over tasks: Spark's own file source keeps every name on the driver.
    """
    files = list_files(spark, path)
    spread = (files if cap is None else files.filter(F.col("length") <= cap)).repartition(4 * spark.sparkContext.defaultParallelism)
    return read_files(spread).select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("dossier_id"), clean_filename(F.col("path")).alias("filename"), "length", "content")


@F.pandas_udf(T.IntegerType())
def _first_bad_byte(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def place(data):
        if data is None:
            return None
        try:
            bytes(data).decode("utf-8")
        except UnicodeDecodeError as error:
            return error.start
        return None

    for series in values:
        yield series.map(place).astype("Int32")


def decode_text(raw: DataFrame) -> DataFrame:
    """`raw` plus text, error (InvalidEncoding) and error_detail (offset of the first bad byte); strict UTF-8 only.

    Only rejected rows' bytes are looked at in Python."""
    text = F.col("content").cast("string")
    good = F.is_valid_utf8(text)
    marked = raw.withColumn("text", F.when(good, text)).withColumn("error", F.when(~good, "InvalidEncoding"))
    return marked.withColumn("error_detail", _first_bad_byte(F.when(F.col("error").isNotNull(), F.col("content"))).cast("string"))


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Pages (dossier_id, doc_id, page_no, text, image_area, page_area) plus `scan`."""
    chars = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+\z", ""))
    share = F.when(F.col("page_area") == 0, 0.0).otherwise(F.col("image_area") / F.col("page_area"))
    return pages.withColumn("scan", F.when(chars == 0, share > 0).otherwise((chars < MIN_CHARS) & (share > MAX_IMAGE_SHARE)))


def rejected_scans(pages: DataFrame) -> DataFrame:
    """Documents with a scanned page: dossier_id, doc_id, page (the first one)."""
    return page_verdicts(pages).groupBy("dossier_id", "doc_id").agg(F.min(F.when(F.col("scan"), F.col("page_no"))).alias("page")).filter("page is not null")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Pages without scans to documents: text and page_offsets (characters before each page)."""
    whole = pages.join(rejected_scans(pages), ["dossier_id", "doc_id"], "left_anti")
    before = Window.partitionBy("dossier_id", "doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = whole.withColumn("_o", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))
    lists = placed.groupBy("dossier_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "_o", "text"))).alias("p"))
    return lists.select("dossier_id", "doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.transform("p", lambda x: x["_o"]).alias("page_offsets"))


def reject_empty(docs: DataFrame) -> DataFrame:
    """Documents whose text is more than white space."""
    return docs.filter(~is_blank(F.col("text")))


def fingerprint(raw: DataFrame) -> DataFrame:
    """`raw` plus the SHA-256 of its bytes."""
    return raw.withColumn("sha256", F.sha2("content", 256))


def reject_oversize(raw: DataFrame, cap: int = MAX_BYTES) -> DataFrame:
    """Documents up to the cap; read_raw_documents with a cap leaves larger files unread."""
    return raw.filter(F.col("length") <= cap)


def admit_documents(docs: DataFrame, cap: int = MAX_DOCUMENTS) -> DataFrame:
    """`docs` plus verdict, in order of arrival: DossierFull once `cap` are in, else DuplicateFilename, else OK. Rejected
    ones take no place."""
    by_name = Window.partitionBy("dossier_id", "filename").orderBy("arrival", "doc_id")
    before = Window.partitionBy("dossier_id").orderBy("arrival", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = docs.withColumn("_first", F.row_number().over(by_name) == 1)
    prior = F.coalesce(F.sum(F.col("_first").cast("int")).over(before), F.lit(0))
    return first.withColumn("verdict", F.when(prior >= cap, "DossierFull").when(~F.col("_first"), "DuplicateFilename").otherwise("OK")).drop("_first")


def export_masked(masked: DataFrame, gate: DataFrame) -> DataFrame:
    """What leaves: dossier_id, filename, masked of dossiers that the gate lets through, and nothing else."""
    return masked.join(gate.filter("verdict = 'OK'").select("dossier_id"), "dossier_id", "left_semi").select("dossier_id", masked_filename(F.col("filename")).alias("filename"), "masked")


def write_export(exported: DataFrame, path: str) -> None:
    exported.write.partitionBy("dossier_id").parquet(path)


def write_files(rows: DataFrame, path: str) -> None:
    """Write (dossier_id, filename, content binary) as one file a row, in a directory for each dossier, in tasks.

    A row that a task writes again replaces its own file. `path` is a URI that driver and executors share.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(path)
        for frame in frames:
            for dossier, name, content in zip(frame["dossier_id"], frame["filename"], frame["content"], strict=True):
                store.create_dir(f"{folder}/{dossier}", recursive=True)
                with store.open_output_stream(f"{folder}/{dossier}/{name}", compression=None) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"written": [len(frame)]})

    rows.select("dossier_id", "filename", "content").mapInPandas(write, "written long").write.format("noop").mode("overwrite").save()


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Returned texts, one file each: dossier_id (directory), answer_id (file name), text; verdict EMPTY for blank ones."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("_path", F.input_file_name())
    return files.select(F.regexp_extract("_path", r"([^/]*)/[^/]*$", 1).alias("dossier_id"), clean_filename(F.col("_path")).alias("answer_id"), F.col("value").alias("text"), F.when(is_blank(F.col("value")), "EMPTY").alias("verdict"))


def find_vault(files: DataFrame, index: DataFrame) -> DataFrame:
    """Masked files (filename) to the vault of their original name (name_sha256, vault_id): vault_id if exactly one, and
    the candidates."""
    original = F.regexp_replace("filename", r"\.mascherato\.txt$", "")
    keyed = files.withColumn("name_sha256", F.sha2(original, 256))
    found = keyed.join(index, "name_sha256", "left").groupBy("filename").agg(F.array_sort(F.collect_set("vault_id")).alias("candidates"))
    return found.select("filename", F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).alias("vault_id"), "candidates")
