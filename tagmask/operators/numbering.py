"""Numbers in order within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagmask.sources.scratch import kept


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str, wide: bool = False) -> DataFrame:
    """`rows` plus `name`: 1, 2, ... within each group, in `order`, which should leave no ties.

    A window numbers each group in one task. `wide` is for groups too large for that: rows are dealt by ranges of group and
    order, each range is numbered by itself and shifted by the group's rows in the ranges before. Only a group that begins in an
    earlier range is shifted, and of these there is at most one a range, so the shifts are broadcast.
    """
    if not wide:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    ranges = kept(rows.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(before)).filter("_before > 0")
    shifts = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_at"), "_before")
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order))
    shifted = ranges.withColumn("_within", within).join(F.broadcast(shifts), same, "left")
    return shifted.select(*rows.columns, (F.col("_within") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))
