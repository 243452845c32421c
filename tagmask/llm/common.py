"""Helpers shared by the training-data operators: tables, written intermediates, guarded joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join counts as small; checked by a count before it is broadcast.
BROADCAST_ROWS = 20_000

#: Rows that Spark sends to Python at once; documents are long, and Spark's default of 10 000 holds tens of MB outside the heap.
ARROW_ROWS = 1000

_own_dirs: dict[str, str] = {}


def _short_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, unless the session has set a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder `sf_dir`."""
    _short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; an own temporary one only where that is unset and
    driver and executors are one process. A cluster without the setting is an error, as executors would not see each other's files."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tagmask-")
        context.setCheckpointDir(_own_dirs[context.applicationId])
    return _own_dirs[context.applicationId]


_made: list[list[str]] = []


@contextmanager
def only_last(spark: SparkSession) -> Iterator[None]:
    """Paths made inside are deleted when the block ends well, but for the last: the result may read no other."""
    _made.append([])
    try:
        yield
    except BaseException:
        _made.pop()
        raise
    paths = _made.pop()
    for path in paths[:-1]:
        remove(spark, path)
    if _made and paths:
        _made[-1].append(paths[-1])


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; its files go when the session ends."""
    path = f"{shared_dir(spark)}/tagmask-{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """The rows of `df` as a table in the shared folder, read again: cuts the lineage and outlives lost executors."""
    _short_batches(df.sparkSession)
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with columns c0, c1, ..., beside which any name with an underscore is free, and a function that takes a
    table with these columns and gives back only them, under their own names."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), lambda out: out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def attach(df: DataFrame, small: DataFrame, on: list[str], spread: str, salts: int = 64, wide: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Left join of `df` with `small`, which has one row per key (nulls are equal).

    `small` is counted: up to BROADCAST_ROWS rows it is broadcast, unless its rows are of no bounded size (`wide`). Else
    the join is dealt by key, and keys with over a 500th of all rows of `df` (so at most 500 of them) are salted by
    `spread`, a column of `df`. `counts` (the key columns and n) says how many rows keys have, where that is known.
    """
    kept, own = [c for c in small.columns if c not in on], df.columns
    values = [F.col(f"_v{i}").alias(c) for i, c in enumerate(kept)]
    keyed = small.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(kept)])
    equal = lambda side: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{side}{i}")) for i, c in enumerate(on)])
    if not wide and small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(keyed), equal("_k"), "left").select(*own, *values)
    counts = df.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.filter(F.col("n") > max(5_000, df.count() // 500)).select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(on)], F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    left = df.join(F.broadcast(hot), equal("_h"), "left").select(*own, salt.alias("_salt"))
    same = reduce(lambda a, b: a & b, [F.col(f"_k{i}").eqNullSafe(F.col(f"_h{i}")) for i in range(len(on))])
    spread_out = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    right = keyed.join(F.broadcast(hot), same, "left").select(*keyed.columns, spread_out.alias("_s"))
    return left.join(right, equal("_k") & (F.col("_salt") == F.col("_s")), "left").select(*own, *values)
