"""Frame planning: object keys, splits, calendars, ledgers and feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo, timegrid
from skyledger.functions.hashing import hash_order
from skyledger.operators.ranking import global_rank, value_totals

BANDS = ("B08", "B13", "B15")
SEGMENTS = (5, 6)


def object_key(frame: Column, band: Column, segment: Column) -> Column:
    # bands B05 to B16 come at 2 km, the others at 1 km
    resolution = F.when(F.substring(band, 2, 2).cast("int").between(5, 16), "R20").otherwise("R10")
    return F.concat(
        timegrid.bucket(frame), F.lit("/AHI-L1b-FLDK/"), F.date_format(frame, "yyyy/MM/dd/HHmm"), F.lit("/HS_"),
        timegrid.satellite_id(frame), F.lit("_"), F.date_format(frame, "yyyyMMdd_HHmm"), F.lit("_"), band,
        F.lit("_FLDK_"), resolution, F.lit("_S"), F.lpad(segment.cast("string"), 2, "0"), F.lit("10.DAT.bz2"),
    )


def frame_objects(frames: DataFrame, bands=BANDS, segments=SEGMENTS) -> DataFrame:
    """Every object a frame needs: frame x bands x segments."""
    return (
        frames.withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
        .withColumn("segment", F.explode(F.array(*[F.lit(s) for s in segments])))
        .withColumn("object_key", object_key(F.col("frame_time"), F.col("band"), F.col("segment")))
    )


def explode_in_step(ledger: DataFrame, keys: str, paths: str) -> DataFrame:
    """One row per object out of two ``;``-joined lists walked together."""
    pairs = F.arrays_zip(F.split(keys, ";").alias("k"), F.split(paths, ";").alias("p"))
    return ledger.select("frame_time", F.explode(pairs).alias("pair")).select(
        "frame_time", F.col("pair.k").alias("object_key"), F.col("pair.p").alias("local_path"),
        F.lit("planned").alias("planning_status"),
    )


def cache_complete(frames: DataFrame, listing: DataFrame) -> DataFrame:
    """A frame is complete when all its objects are in the listing."""
    have = listing.select("object_key").distinct().withColumn("present", F.lit(True))
    objects = frame_objects(frames).join(have, "object_key", "left")
    return objects.groupBy("frame_time").agg(
        F.bool_and(F.coalesce("present", F.lit(False))).alias("cached"),
        F.count_if(F.col("present").isNull()).alias("missing_objects"),
    )


def split_by_time_quantile(df: DataFrame, bin_col: str, train: float = 0.70, val: float = 0.85) -> DataFrame:
    """Chronological split at the 70 % and 85 % positions of the distinct time bins."""
    bins = df.select(F.lit(0).alias("all"), F.unix_seconds(bin_col).alias("t")).distinct()
    totals = value_totals(bins, ["all"], "t", {"n": F.count(F.lit(1))})
    cuts = totals.agg(
        F.min(F.when(F.col("cum_n") > F.floor(F.lit(train) * F.col("all_n")), F.col("t"))).alias("t1"),
        F.min(F.when(F.col("cum_n") > F.floor(F.lit(val) * F.col("all_n")), F.col("t"))).alias("t2"),
    ).first()
    at = F.unix_seconds(bin_col)
    return df.withColumn(
        "split", F.when(at < F.lit(cuts["t1"]), "train").when(at < F.lit(cuts["t2"]), "val").otherwise("test")
    )


def split_by_position(df: DataFrame, seed: str, key: str, train: float = 0.7, val_end: float = 0.85) -> DataFrame:
    """Shuffle by hash, then cut at the whole positions below the shares ``train`` and ``val_end``."""
    ranked = global_rank(df.withColumn("_order", hash_order(seed, key)), [], ["_order", key], "position")
    total = ranked.count()
    first, second = int(train * total), int(val_end * total)
    return ranked.drop("_order").withColumn(
        "split",
        F.when(F.col("position") <= first, "train").when(F.col("position") <= second, "val").otherwise("test"),
    )


def with_crop(df: DataFrame, mask=geo.MASK, size: int = 64) -> DataFrame:
    """Pixel, crop bounds; rows whose crop leaves the image are rejected."""
    x, y = geo.to_pixel(F.col("lat"), F.col("lon"), mask)
    out = df.withColumns({"x": x, "y": y}).withColumn("crop", geo.crop(F.col("x"), F.col("y"), size))
    return out.where(geo.crop_inside(F.col("crop"), mask))


def with_geometry(df: DataFrame, mask=geo.MASK) -> DataFrame:
    """Crop edges in degrees, distance to the mask boundary, grid cell."""
    north, west = geo.to_lonlat(F.col("crop.x0"), F.col("crop.y0"), mask)
    south, east = geo.to_lonlat(F.col("crop.x1") - 1, F.col("crop.y1") - 1, mask)
    return df.withColumns({
        "crop_north": north, "crop_south": south, "crop_west": west, "crop_east": east,
        "distance_to_boundary_km": geo.boundary_distance_km(F.col("lat"), F.col("lon"), mask),
        "grid_cell": geo.grid_label(F.col("lat"), F.col("lon"), mask),
    })


def kind_code(kind: Column) -> Column:
    return F.when(kind == "Cloud", 0).when(kind == "Ground", 1).otherwise(2)


def metadata_vector(ts: str = "ts") -> dict[str, Column]:
    """Scaled metadata features; the centres and scales are fixed values."""
    month = F.month(ts)
    return {
        "lat_norm": (F.col("lat") - 3.0) / 3.0,
        "lon_norm": (F.col("lon") - 102.0) / 2.5,
        "amp_norm": F.least(F.greatest(F.col("amplitude") / 10.0, F.lit(-1.0)), F.lit(1.0)),
        "month_norm": (month - 6.5) / 5.5,
        "day_norm": (F.dayofyear(ts) - 183.0) / 182.0,
        "season_norm": timegrid.season(month) / 3.0,
    }


def bin_summary(strikes: DataFrame) -> DataFrame:
    """Count and centroid of the strikes of each slot."""
    return strikes.groupBy(timegrid.floor_slot(F.col("ts")).alias("frame_time")).agg(
        F.count(F.lit(1)).alias("strike_count"),
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"),
    )


def bin_calendar(strikes: DataFrame) -> DataFrame:
    """144 slots for every date that has valid data; other dates stay unknown."""
    days = strikes.where(F.col("ts").isNotNull()).select(F.to_date("ts").alias("date")).distinct()
    start = F.col("date").cast("timestamp")
    slots = days.select(
        "date", F.explode(F.sequence(start, timegrid.plus_minutes(start, 1430), F.expr("interval 10 minutes")))
        .alias("frame_time")
    )
    active = (
        strikes.where(F.lower(F.trim("kind")) == "ground")
        .select(timegrid.floor_slot(F.col("ts")).alias("frame_time")).distinct()
        .withColumn("_hit", F.lit(True))
    )
    hit = F.coalesce("_hit", F.lit(False))
    return slots.join(active, "frame_time", "left").select(
        "frame_time", "date", hit.alias("recorded_ground_event"),
        F.when(hit, "active").otherwise("zero_recorded").alias("category"),
    )


def candidate_ledger(calendar: DataFrame, summary: DataFrame) -> DataFrame:
    """Calendar with in-mask counts; the category is re-derived from that count."""
    count = F.coalesce("strike_count", F.lit(0))
    return calendar.drop("category").join(summary, "frame_time", "left").select(
        "frame_time", "date", "recorded_ground_event", count.alias("in_mask_count"),
        F.when(count > 0, "active").otherwise("zero_recorded").alias("category"),
        "centroid_lat", "centroid_lon",
    )


def with_local_time(ledger: DataFrame) -> DataFrame:
    hour = timegrid.local_hour(F.col("frame_time"))
    return ledger.withColumns({
        "month": F.month("frame_time"), "local_hour": hour,
        "local_time_block": timegrid.time_block(hour), "stratum": timegrid.stratum(F.month("frame_time"), hour),
    })


def version_stamp(df: DataFrame, config_hash: str, rule_version: str, seed: int, phase: str) -> DataFrame:
    """Provenance columns of a frozen plan."""
    return df.withColumns({
        "configuration_hash": F.lit(config_hash), "label_rule_version": F.lit(rule_version),
        "random_selection_seed": F.lit(seed), "phase": F.lit(phase),
        "selection_reason": F.when(F.col("category") == "active", "support and diversity")
        .otherwise("matched to selected active frames"),
    })


def group_disjoint_split(df: DataFrame, group: str, ts: str, train_end: str, val_end: str) -> DataFrame:
    """Each group takes the split of its latest member."""
    latest = df.groupBy(group).agg(F.max(ts).alias("latest"))
    return df.join(latest, group).withColumn("split", timegrid.split_by_instant(F.col("latest"), train_end, val_end))


def reconcile_splits(df: DataFrame, split: Column) -> DataFrame:
    """Recomputed split beside the stored one."""
    return df.withColumn("new_split", split).withColumn("changed", ~F.col("split").eqNullSafe(F.col("new_split")))


def complete_frames(planned: DataFrame, completed: DataFrame, bands: str, segments: str) -> DataFrame:
    """Identifiers of planned frames all of whose rows agree in split, bands, segments, window and paths."""
    wanted = planned.select(
        "frame_id", F.col("split").alias("_split"), F.col("window_start").alias("_ws"), F.col("window_end").alias("_we")
    )
    agrees = (
        (F.col("split") == F.col("_split")) & (F.col("bands") == bands) & (F.col("segments") == segments)
        & (F.col("window_start") == F.col("_ws")) & (F.col("window_end") == F.col("_we")) & (F.col("path") != "")
    )
    rows = completed.join(wanted, "frame_id").groupBy("frame_id")
    return rows.agg(F.bool_and(F.coalesce(agrees, F.lit(False))).alias("ok")).where("ok").select("frame_id")


def pending_frames(planned: DataFrame, completed: DataFrame, bands: str, segments: str) -> DataFrame:
    """Planned frames without a completed manifest that agrees in split, bands, segments and paths."""
    return planned.join(complete_frames(planned, completed, bands, segments), "frame_id", "left_anti")


def resumed_manifest(planned: DataFrame, completed: DataFrame, redone: DataFrame, bands: str, segments: str) -> DataFrame:
    """The manifest after a resumed build: rows of complete frames as they were, all others from ``redone``.

    Rows of incomplete or unplanned frames go, and so do redone rows of frames that needed no work.
    """
    whole = complete_frames(planned, completed, bands, segments)
    fresh = redone.join(planned.select("frame_id"), "frame_id", "left_semi").join(whole, "frame_id", "left_anti")
    kept = completed.join(whole, "frame_id", "left_semi").withColumn("kept", F.lit(True))
    return kept.unionByName(fresh.withColumn("kept", F.lit(False)))
