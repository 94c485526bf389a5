"""Occurrence cells: gridded event counts with sampled empty cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo, timegrid
from skyledger.functions.hashing import hash_order
from skyledger.operators import joins, planning

STEP = 0.5


def grid_shape(mask=geo.MASK, step: float = STEP) -> tuple[int, int]:
    return int((mask.lat_max - mask.lat_min) // step), int((mask.lon_max - mask.lon_min) // step)


def occurrence_cells(strikes: DataFrame, mask=geo.MASK, step: float = STEP, seconds: int = 3600) -> DataFrame:
    """Event count per (time bin, cell), label 1."""
    return (
        strikes.where(mask.contains(F.col("lat"), F.col("lon")))
        .groupBy(
            timegrid.floor_slot(F.col("ts"), seconds).alias("time_bin"),
            geo.cell_index(F.col("lat"), mask.lat_min, mask.lat_max, step).alias("lat_idx"),
            geo.cell_index(F.col("lon"), mask.lon_min, mask.lon_max, step).alias("lon_idx"),
        )
        .agg(F.count(F.lit(1)).alias("strike_count"))
        .withColumn("label", F.lit(1))
    )


def occurrence_negatives(cells: DataFrame, ratio: int = 3, seed: str = "neg", mask=geo.MASK, step: float = STEP) -> DataFrame:
    """Per time bin ``min(free, ratio * positives)`` empty cells in hash order.

    A window partition is one time bin and holds at most the grid's cells.
    """
    quota = cells.groupBy("time_bin").agg((F.count(F.lit(1)) * ratio).alias("_quota"))
    order = hash_order(seed, F.unix_seconds("time_bin"), "lat_idx", "lon_idx")
    window = Window.partitionBy("time_bin").orderBy("_order", "lat_idx", "lon_idx")
    return (
        joins.free_cells(cells, *grid_shape(mask, step)).withColumn("_order", order)
        .withColumn("_rn", F.row_number().over(window)).join(quota, "time_bin").where(F.col("_rn") <= F.col("_quota"))
        .select("time_bin", "lat_idx", "lon_idx", F.lit(0).cast("bigint").alias("strike_count"), F.lit(0).alias("label"))
    )


def occurrence_dataset(strikes: DataFrame, ratio: int = 3, seed: str = "neg", mask=geo.MASK, step: float = STEP) -> DataFrame:
    cells = occurrence_cells(strikes, mask, step)
    rows = cells.unionByName(occurrence_negatives(cells, ratio, seed, mask, step))
    month = F.month("time_bin")
    rows = rows.withColumns({
        "latitude": geo.cell_centre(F.col("lat_idx"), mask.lat_min, step),
        "longitude": geo.cell_centre(F.col("lon_idx"), mask.lon_min, step),
        "month": month, "hour": F.hour("time_bin"), "day_of_year": F.dayofyear("time_bin"), "season": timegrid.season(month),
    })
    return planning.split_by_time_quantile(rows, "time_bin")
