"""Patch and pixel operators over long pixel rows ``(frame_id, y, x, bands...)``."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.hashing import uniform

# fixed values: physical brightness-temperature ranges in kelvin
RANGES_K = {"B08": (190.0, 260.0), "B13": (180.0, 330.0), "B15": (180.0, 330.0)}
# fixed values: channel means and deviations the two model families expect
MEAN_STD = {
    "small": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)),
    "pretrained": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
}
BANDS = ("b08", "b13", "b15")


def band_to_uint8(kelvin: Column, band: str) -> Column:
    """Clip to the band's range, scale to 0-255 with half-even rounding; NaN becomes 0."""
    low, high = RANGES_K.get(band, (180.0, 330.0))
    clipped = F.least(F.greatest(kelvin, F.lit(low)), F.lit(high))
    return F.when(F.isnan(kelvin), 0).otherwise(F.rint((clipped - low) / (high - low) * 255.0)).cast("int")


def finite_value(value: Column) -> Column:
    """NaN and -inf to 0, +inf to 255, the rest clipped to bytes."""
    return F.when(F.isnan(value), 0.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0))).cast("int")


def is_black(threshold: int) -> Column:
    dark = F.lit(True)
    for band in BANDS:
        dark = dark & (F.col(band) < threshold)
    return dark


def black_fraction(pixels: DataFrame, keys: list[str], threshold: int = 8, patches: DataFrame | None = None) -> DataFrame:
    """Share of black pixels. ``patches(keys)`` lists all patches: one without pixels is wholly black."""
    shares = pixels.groupBy(*keys).agg(F.avg(is_black(threshold).cast("int")).alias("black_fraction"))
    if patches is None:
        return shares
    return patches.select(*keys).distinct().join(shares, keys, "left").withColumn("black_fraction", F.coalesce("black_fraction", F.lit(1.0)))


def valid_coverage(
    pixels: DataFrame, keys: list[str], maximum: float = 0.02, threshold: int = 8, patches: DataFrame | None = None
) -> DataFrame:
    return black_fraction(pixels, keys, threshold, patches).where(F.col("black_fraction") <= maximum)


def summed_areas(pixels: DataFrame, frame: str = "frame_id") -> DataFrame:
    """One row per frame that has pixels: ``dark``, its summed-area table.

    ``pixels(frame, x, y)`` are the pixels to count (the black ones). A table holds the columns
    and rows at which a run of pixels starts or ends (``xs``, ``ys``) and, for each of their
    crossings, the number of pixels above and to the left (``sums``, row by row). Between two
    edges the raster is constant, so ``dark_pixels`` is exact at any place, and a frame of a few
    black areas is a few numbers. The sums are two windows over the lines of one frame.
    """
    spots = pixels.select(frame, "x", "y")

    def edges(axis: str, across: str) -> DataFrame:
        line = Window.partitionBy(frame, across).orderBy(axis)
        runs = spots.withColumns({"_before": F.lag(axis).over(line), "_after": F.lead(axis).over(line)})
        starts = F.when(F.col("_before").isNull() | (F.col(axis) - F.col("_before") > 1), F.col(axis))
        stops = F.when(F.col("_after").isNull() | (F.col("_after") - F.col(axis) > 1), F.col(axis) + 1)
        return runs.select(frame, F.explode(F.array_compact(F.array(starts, stops))).alias(axis)).distinct()

    corners = edges("x", "y").join(edges("y", "x"), frame)
    set_here = spots.join(corners, [frame, "x", "y"], "left_semi").distinct().withColumn("_set", F.lit(1))
    along, down = Window.partitionBy(frame, "y").orderBy("x"), Window.partitionBy(frame, "x").orderBy("y")
    before = (Window.unboundedPreceding, -1)
    sized = corners.join(set_here, [frame, "x", "y"], "left").withColumns({
        "_w": F.lead("x").over(along) - F.col("x"), "_h": F.lead("y").over(down) - F.col("y"),
    }).withColumn("_area", F.coalesce(F.col("_set") * F.col("_w") * F.col("_h"), F.lit(0)).cast("int"))
    rows = sized.withColumn("_row", F.coalesce(F.sum("_area").over(along.rowsBetween(*before)), F.lit(0)))
    table = rows.withColumn("_sum", F.coalesce(F.sum("_row").over(down.rowsBetween(*before)), F.lit(0)).cast("int"))
    return table.groupBy(frame).agg(F.struct(
        F.array_sort(F.collect_set("x")).alias("xs"), F.array_sort(F.collect_set("y")).alias("ys"),
        F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "_sum"))), lambda p: p["_sum"]).alias("sums"),
    ).alias("dark"))


def dark_pixels(crop: Column, dark: Column) -> Column:
    """Number of counted pixels inside a crop: four look-ups in the frame's table (no table: 0)."""
    xs, ys, sums = dark["xs"], dark["ys"], dark["sums"]

    def place(edges: Column, value: Column) -> Column:
        """The last edge up to ``value`` (1, 2, ...; 0 for none) and how far beyond it ``value`` is, as a share of the way to the next."""
        def found(k: Column) -> Column:
            low, high = F.element_at(edges, k), F.element_at(edges, F.least(k + 1, F.size(edges)))
            return F.struct(k.alias("k"), F.least(k + 1, F.size(edges)).alias("next"), F.when(high > low, (F.least(value, high) - low) / (high - low)).otherwise(0.0).alias("part"))

        count = F.size(F.filter(edges, lambda v: v <= value))
        return F.transform(F.array(count), lambda k: F.when(k > 0, found(k)))[0]

    def below(x: Column, y: Column) -> Column:
        """Pixels above and to the left of a place; whole, as the raster is constant between edges."""
        def at(k: Column, row: Column) -> Column:
            return F.element_at(sums, (row - 1) * F.size(xs) + k)

        upper = at(x["k"], y["k"]) * (1 - x["part"]) + at(x["next"], y["k"]) * x["part"]
        lower = at(x["k"], y["next"]) * (1 - x["part"]) + at(x["next"], y["next"]) * x["part"]
        return F.when(x.isNotNull() & y.isNotNull(), upper * (1 - y["part"]) + lower * y["part"]).otherwise(0.0)

    # a lambda binds the four places, so that each is found once
    ends = F.array(F.struct(*[place(xs if e[0] == "x" else ys, crop[e]).alias(e) for e in ("x0", "x1", "y0", "y1")]))
    counted = F.transform(ends, lambda p: below(p["x1"], p["y1"]) - below(p["x0"], p["y1"]) - below(p["x1"], p["y0"]) + below(p["x0"], p["y0"]))[0]
    return F.when(dark.isNull(), 0).otherwise(F.round(counted)).cast("int")


def patch_extract(pixels: DataFrame, crops: DataFrame, tile: int = 64) -> DataFrame:
    """Pixels of each crop with coordinates inside the crop.

    Frames are cut into tiles; a crop meets only the tiles it overlaps.
    """
    def covers(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile))

    tiled = pixels.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    spread = crops.withColumn("ty", F.explode(covers("y0", "y1"))).withColumn("tx", F.explode(covers("x0", "x1")))
    inside = (
        (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    )
    return spread.join(tiled, ["frame_id", "ty", "tx"]).where(inside).withColumns({
        "px": F.col("x") - F.col("x0"), "py": F.col("y") - F.col("y0"),
    }).drop("ty", "tx")


def patch_tiles(frames: DataFrame, height: int, width: int, size: int, stride: int, ragged: bool = False) -> DataFrame:
    """Crop bounds of a tiling; edge tiles are kept clipped (``ragged``) or dropped."""
    def starts(limit: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(limit - 1), F.lit(stride)))

    tiles = frames.withColumn("y0", starts(height)).withColumn("x0", starts(width))
    tiles = tiles.withColumns({
        "y1": F.least(F.col("y0") + size, F.lit(height)), "x1": F.least(F.col("x0") + size, F.lit(width)),
    })
    whole = (F.col("y1") - F.col("y0") == size) & (F.col("x1") - F.col("x0") == size)
    return tiles if ragged else tiles.where(whole)


def channel_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(
        *[F.avg(b).alias(f"mean_{b}") for b in BANDS], F.min("b13").alias("min_b13")
    )


def normalize(family: str) -> dict[str, Column]:
    means, deviations = MEAN_STD[family]
    return {b: (F.col(b) / 255.0 - m) / s for b, m, s in zip(BANDS, means, deviations)}


def augment_right_angle(pixels: DataFrame, size: int, seed: str, key: str = "frame_id") -> DataFrame:
    """Hash-chosen flips and quarter turns of each patch, as a move of pixel coordinates."""
    last = size - 1
    x = F.when(uniform(f"{seed}h", key) < 0.5, last - F.col("x")).otherwise(F.col("x"))
    y = F.when(uniform(f"{seed}v", key) < 0.5, last - F.col("y")).otherwise(F.col("y"))
    turns = F.floor(uniform(f"{seed}r", key) * 4)
    nx = F.when(turns == 0, x).when(turns == 1, y).when(turns == 2, last - x).otherwise(last - y)
    ny = F.when(turns == 0, y).when(turns == 1, last - x).when(turns == 2, last - y).otherwise(x)
    return pixels.withColumns({"x": nx.cast("int"), "y": ny.cast("int")})


def patch_facts(pixels: DataFrame, key: str) -> DataFrame:
    """Size, spread, darkness and content digest of each patch (a patch has few pixels)."""
    value = F.concat_ws(",", *[F.col(b).cast("string") for b in BANDS])
    order = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", value.alias("v")))), lambda p: p["v"])
    low, high = F.least(*BANDS), F.greatest(*BANDS)
    return pixels.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.min(low).alias("low"), F.max(high).alias("high"),
        F.avg(is_black(1).cast("int")).alias("zero_share"),
        reduce(add, [F.max(F.col(b).isNotNull().cast("int")) for b in BANDS]).alias("channels"),
        F.count_if(F.isnan("kelvin") | (F.abs("kelvin") == float("inf"))).alias("nonfinite"),
        F.md5(F.array_join(order, ";").cast("binary")).alias("digest"),
    )


def patch_audit(manifest: DataFrame, facts: DataFrame, pixels_per_patch: int) -> DataFrame:
    """One row of defect counts over manifest rows and the facts of their patches.

    Repeats are counted from group sizes, so a digest shared by many rows stays cheap.
    """
    joined = manifest.join(facts, "patch_id", "left")
    there = F.col("n_pixels").isNotNull()
    counts = joined.agg(
        F.count_if(~there).alias("missing"), F.count_if(there & (F.col("channels") != len(BANDS))).alias("wrong_channels"), F.count_if(there & (F.col("n_pixels") != pixels_per_patch)).alias("wrong_dimensions"),
        F.count_if(F.col("low") == F.col("high")).alias("constant"), F.count_if(F.col("zero_share") > 0.02).alias("black"),
        F.count_if(F.col("nonfinite") > 0).alias("nonfinite"), F.count_if(F.col("digest") != F.col("sha")).alias("hash_mismatch"),
        F.count_if(~F.col("path").contains(F.concat(F.lit("/"), "split", F.lit("/")))).alias("incorrect_split_path"),
        F.count_if((F.col("label") == 1) != F.col("path").contains("/positive/")).alias("incorrect_label_metadata"),
    )

    def repeats(column: str, name: str) -> DataFrame:
        return manifest.groupBy(column).agg((F.count(F.lit(1)) - 1).alias("r")).agg(F.sum("r").alias(name))

    parts = counts.unionByName(repeats("sha", "duplicate_file_hash"), allowMissingColumns=True).unionByName(
        repeats("crop_key", "duplicate_crop"), allowMissingColumns=True
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def black_scan(fractions: DataFrame) -> DataFrame:
    """Per label: how dark the patches are."""
    from skyledger.operators.ranking import exact_quantiles

    f = F.col("black_fraction")
    counts = fractions.groupBy("label").agg(
        F.count(F.lit(1)).alias("count"), F.avg(f).alias("mean"), F.max(f).alias("maximum"),
        F.count_if(f > 0.02).alias("gt_02pct"), F.count_if(f > 0.3).alias("gt_30pct"),
        F.count_if(f > 0.5).alias("gt_50pct"), F.count_if(f == 1.0).alias("exact_100pct"),
    )
    median = exact_quantiles(fractions, ["label"], "black_fraction", {"median": 0.5}).drop("n")
    return counts.join(median, "label")
