"""Tables that a job keeps for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Of every `passing` that is open: the folders and tables made since.
_made: list[list[tuple[str, str | None]]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the session ends. It lies under spark.checkpoint.dir; only
    where that is unset and driver and executors are one process, in a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tagmask-")
        named = _own[context.applicationId]
    path = f"{named.rstrip('/')}/tagmask-{uuid.uuid4().hex}"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    _note(path)
    return path


def _note(path: str, table: str | None = None) -> None:
    for made in _made[-1:]:
        made.append((path, table))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is kept in here goes at the end: a batch of a stream leaves nothing but what it has written elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for path, table in _made.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind: nothing else reads them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(table: DataFrame) -> DataFrame:
    """The rows as a written table, read again: what they are made of is evaluated once, however often they are used."""
    path = scratch(table.sparkSession)
    with shuffles_go(table.sparkSession):
        table.write.option("compression", "zstd").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def kept_by(table: DataFrame, key: str) -> DataFrame:
    """As `kept`, dealt by a key that Spark knows of: grouping by it, and joining two such tables, needs no shuffle."""
    spark = table.sparkSession
    name, path, n = f"tagmask_{uuid.uuid4().hex}", scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    _note(path, name)
    with shuffles_go(spark):
        table.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).format("parquet").saveAsTable(name)
    return spark.table(name)
