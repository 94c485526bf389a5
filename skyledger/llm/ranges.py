"""Prefix sums over one global order, for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import cut


def free(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the inclusive running sum of each value along ``order``.

    The rows are range-partitioned and written once, each range is summed alone and shifted by
    the totals of the ranges before it. Only one row per range (as many as partitions) meets in
    one task. The order must be total for repeatable results; nulls go where ``order`` puts them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    local = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.select("*", *[F.sum(c).over(local).alias(f"_c_{k}") for k, c in sums.items()])
        .join(shifts, "_range")
        .select(*df.columns, *[(F.col(f"_c_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])
    )
