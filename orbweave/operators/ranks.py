"""Places of rows in an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.storage import materialise


def summed_before(rows: DataFrame, order: list[str | Column], weight: str, by: tuple[str, ...] = (), name: str = "before", parts: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows before them in their group ``by``, found as ``placed`` finds places."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(*by, "_part").agg(F.sum(weight).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_in"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    inside = F.sum(weight).over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("_part") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    numbered = ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(begins, same)
    return numbered.select(*rows.columns, (F.col("_begin") + F.col("_inside")).alias(name))


def placed(rows: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), name: str = "place", parts: int | None = None) -> DataFrame:
    """``rows`` with each row's place (from 0) in its group ``by``; ``order`` must not tie two rows of a group.

    Rows are range-partitioned by group and order and written with the number of their partition. They are numbered
    inside a partition; where a partition begins in a group is a prefix sum over counts, a row per group and partition.
    A group that holds most rows thus spans many partitions. Empty tables stay empty; null keys are a group.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    same = F.col("_part") == F.col("_in")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    numbered = ranged.withColumn("_inside", inside).join(begins, same)
    return numbered.select(*rows.columns, (F.col("_begin") + F.col("_inside") - 1).alias(name))
