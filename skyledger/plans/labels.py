"""Positive, matched-negative and natural-prevalence labelling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo, timegrid
from skyledger.functions.hashing import uniform
from skyledger.operators import joins, planning, raster, selection
from skyledger.operators.ranking import global_rank, take_per_group
from skyledger.session import cut


def assign_targets(zero: DataFrame, targets: DataFrame, per_frame: int) -> DataFrame:
    """Empty frames draw targets of their split round-robin, in frame order."""
    slots = zero.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(per_frame - 1))))
    slots = global_rank(slots, ["split"], ["frame_time", "number"], "_i")
    ring = global_rank(targets, ["split"], ["ts", "lat", "lon", "target"], "_j")
    sizes = ring.groupBy("split").agg(F.count(F.lit(1)).alias("_m"))
    return (
        slots.join(sizes, "split").withColumn("_j", F.pmod(F.col("_i") - 1, F.col("_m")) + 1)
        .join(ring, ["split", "_j"]).drop("_i", "_j", "_m")
    )


# fixed order in which the cell of a target and its neighbours are tried: (rows, columns)
OFFSETS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, 1), (-1, 1), (1, -1)]
DRAWS = 200
SIZE, DEGREES, GRID = 64, 0.02, 0.5
NEGATIVE_WINDOW = (-20, 30, 10.0)
MAX_BLACK = 0.02


def with_images(frames: DataFrame, images: DataFrame, pixels: DataFrame) -> DataFrame:
    """``frames(image_id)`` with ``readable`` and ``dark``, the summed-area table of the image's black pixels.

    ``images(image_id, readable)`` lists the images; ``pixels(image_id, x, y, bands)`` are their rows.
    A frame whose image is missing is not readable.
    """
    tables = raster.summed_areas(pixels.where(raster.is_black(8)), "image_id")
    known = images.select("image_id", "readable").join(tables, "image_id", "left")
    seen = frames.join(known, "image_id", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    return cut(seen)  # read several times, and a table is one row of a frame


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that are few bytes but much work, spread over all tasks: a number that is given is not coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def covered(placed: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows whose crop lost at most ``MAX_BLACK`` of its pixels; ``dark`` is dropped.

    What passes is written, as it is read several times, and as the optimizer would carry the long
    predicate through every later join.
    """
    return cut(placed.where(raster.dark_pixels(F.col("crop"), F.col("dark")) <= MAX_BLACK * size * size).drop("dark"))


# a grid cell is tested in PARTS x PARTS parts; all their bits set mean that no centre of the cell is clear
PARTS = 5
WHOLE = 2 ** (PARTS * PARTS) - 1
BOX = SIZE * DEGREES / 2 + NEGATIVE_WINDOW[2] / geo.KM_PER_DEGREE


def _cell_key(row: Column, col: Column) -> Column:
    return (row * 1000 + col).cast("int")


def blocked_parts(frames: DataFrame, strikes: DataFrame, mask=geo.MASK, tile: float = 0.25) -> DataFrame:
    """(frame_time, blocked): per grid cell a bit for each part that lies whole in the box of an event of the window.

    No draw in such a part is clear. One event stands for its tile and ten minutes, so that crowds
    cost no more; what it leaves open is still tested exactly.
    """
    def reach(value: str, low: float, high: float) -> Column:
        """Cells (number, bits of their parts) that the event's box covers along one axis."""
        cells = []
        for i in range(math.ceil((high - low) / GRID)):
            a, b = low + i * GRID, min(low + (i + 1) * GRID, high)
            ends = [(a + (b - a) * k / PARTS, a + (b - a) * (k + 1) / PARTS) for k in range(PARTS)]
            bits = sum(F.when(F.greatest(F.abs(F.col(value) - p), F.abs(F.col(value) - q)) <= BOX - 1e-9, 1 << k).otherwise(0) for k, (p, q) in enumerate(ends))
            cells.append(F.when(bits > 0, F.struct(F.lit(i).alias("i"), bits.alias("bits"))))
        return F.array_compact(F.array(*cells))

    spot = [timegrid.slot_number(F.col("ts")).alias("s"), F.floor(F.col("lat") / tile).alias("a"), F.floor(F.col("lon") / tile).alias("o")]
    events = strikes.groupBy(*spot).agg(F.min(F.struct("ts", "lat", "lon")).alias("e")).select("e.*")
    spans = cut(events.select("ts", reach("lat", mask.lat_min, mask.lat_max).alias("rows"), reach("lon", mask.lon_min, mask.lon_max).alias("cols")))
    near = joins.window_join(dealt(frames.select("frame_time").distinct()), spans, *NEGATIVE_WINDOW[:2])
    cells = near.withColumn("r", F.explode("rows")).withColumn("c", F.explode("cols"))
    bits = sum(F.when(F.getbit(F.col("r.bits"), F.lit(k)) == 1, F.shiftleft(F.col("c.bits"), PARTS * k)).otherwise(0) for k in range(PARTS))
    masks = cells.groupBy("frame_time", _cell_key(F.col("r.i"), F.col("c.i")).alias("cell")).agg(F.bit_or(bits).alias("bits"))
    return masks.groupBy("frame_time").agg(F.map_from_entries(F.collect_list(F.struct("cell", "bits"))).alias("blocked"))


def _levels(mask=geo.MASK) -> Column:
    """Cells to try for a target, without those that cannot hold a usable centre.

    A cell is dropped when it misses the mask, when all its centres fall outside the image,
    when the target is itself an event of the frame whose box covers the whole cell, or when
    the events of the window block all its parts. Every draw in such a cell fails, so dropping
    it changes no result.
    """
    row = F.floor((F.col("t_lat") - mask.lat_min) / GRID)
    col = F.floor((F.col("t_lon") - mask.lon_min) / GRID)
    half = SIZE // 2
    cells = []
    for level, (dy, dx) in enumerate(OFFSETS):
        lat0, lon0 = F.lit(mask.lat_min) + (row + dy) * GRID, F.lit(mask.lon_min) + (col + dx) * GRID
        lat_low, lat_high = F.greatest(lat0, F.lit(mask.lat_min)), F.least(lat0 + GRID, F.lit(mask.lat_max))
        lon_low, lon_high = F.greatest(lon0, F.lit(mask.lon_min)), F.least(lon0 + GRID, F.lit(mask.lon_max))
        x_low, y_high = geo.to_pixel(lat_low, lon_low, mask)
        x_high, y_low = geo.to_pixel(lat_high, lon_high, mask)
        reachable = (x_high >= half) & (x_low < mask.width - half) & (y_high >= half) & (y_low < mask.height - half)
        reach_lat = F.greatest(F.abs(lat_low - F.col("t_lat")), F.abs(lat_high - F.col("t_lat")))
        reach_lon = F.greatest(F.abs(lon_low - F.col("t_lon")), F.abs(lon_high - F.col("t_lon")))
        smothered = F.col("own") & (reach_lat <= BOX) & (reach_lon <= BOX)
        blocked = F.coalesce(F.try_element_at("blocked", _cell_key(row + dy, col + dx)), F.lit(0))
        cells.append(F.when(
            (lat_low < lat_high) & (lon_low < lon_high) & reachable & ~smothered & (blocked != WHOLE),
            F.struct(
                F.lit(level).alias("level"), lat_low.alias("la"), lat_high.alias("lb"), lon_low.alias("oa"), lon_high.alias("ob"),
                blocked.alias("blocked"),
            ),
        ))
    return F.array_compact(F.array(*cells))


def _usable(targets: DataFrame, strikes: DataFrame, first: int, last: int | None, low: int, high: int) -> DataFrame:
    """Usable draws ``low..high`` in the ``first..last`` live cells of each target."""
    cells = F.slice("levels", first, last - first + 1) if last else F.slice("levels", first, len(OFFSETS))
    spread = (
        dealt(targets).withColumn("c", F.explode(cells))
        .withColumn("draw", F.explode(F.sequence(F.lit(low), F.lit(high))))
    )
    key = [F.unix_seconds("frame_time"), F.col("number"), F.col("c.level"), F.col("draw")]
    up, along = uniform("mla", *key), uniform("mlo", *key)
    lat = F.col("c.la") + (F.col("c.lb") - F.col("c.la")) * up
    lon = F.col("c.oa") + (F.col("c.ob") - F.col("c.oa")) * along
    part = (F.floor(up * PARTS) * PARTS + F.floor(along * PARTS)).cast("int")
    drawn = spread.where(F.getbit(F.col("c.blocked"), part) == 0).select("frame_time", "number", "dark", F.col("c.level").alias("level"), "draw", lat.alias("lat"), lon.alias("lon"))
    half = SIZE // 2
    mask = geo.MASK
    inside = (
        (F.col("x") >= half) & (F.col("y") >= half) & (F.col("x") < mask.width - half) & (F.col("y") < mask.height - half)
    )
    x, y = geo.to_pixel(F.col("lat"), F.col("lon"))
    placed = drawn.withColumns({"x": x, "y": y}).where(inside).withColumn("crop", geo.crop(F.col("x"), F.col("y"), SIZE))
    return joins.patch_clear(covered(placed), strikes, *NEGATIVE_WINDOW).where("clear").drop(
        "start_min", "end_min", "margin_km", "clear", "inside_count"
    )


def matched_negatives(targets: DataFrame, strikes: DataFrame) -> DataFrame:
    """One matched empty patch per target, where one exists.

    ``targets(frame_time, number, t_lat, t_lon, own, dark, pos_crop)``: a target's
    usable draws are those in the image, covered and clear, in (cell, draw) order. Within a
    frame, targets pick in ``number`` order the first usable crop that no positive up to
    theirs and no earlier pick already uses.

    Draws are made in stages for the targets still open. Only frames in which first choices
    collide go through the ordered pick, with the first ``2 n + 1`` distinct crops of each
    of their ``n`` targets, which always suffices.
    """
    key = ["frame_time", "number"]
    targets = cut(targets)
    targets = cut(targets.join(blocked_parts(targets, strikes), "frame_time", "left").withColumn("levels", _levels()).drop("blocked"))
    order = F.struct("level", "draw", "lat", "lon", "x", "y", "crop")
    stages = [(1, 1, 1, 20), (1, 2, 1, DRAWS), (1, None, 1, DRAWS)]
    waiting, found = targets, None
    for first, last, low, high in stages:
        usable = _usable(waiting, strikes, first, last, low, high)
        best = cut(usable.groupBy(*key).agg(F.min(order).alias("pick")))
        found = best if found is None else found.unionByName(best)
        waiting = waiting.join(best, key, "left_anti")
    first_choice = targets.join(found, key, "left")
    crops = first_choice.select("frame_time", F.explode(F.array_compact(F.array("pos_crop", "pick.crop"))).alias("k"))
    clash = cut(
        crops.groupBy("frame_time", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("frame_time").distinct()
    )
    out = first_choice.where("pick is not null").select(*key, "pick.*", "t_lat", "t_lon")
    if not clash.isEmpty():
        hard = targets.join(clash, "frame_time", "left_semi")
        out = out.join(clash, "frame_time", "left_anti").unionByName(_ordered_picks(hard, strikes, order))
    return out.withColumn(
        "match_level", F.when(F.col("level") == 0, "same_grid_cell").otherwise("neighbour_grid_cell")
    )


def _ordered_picks(targets: DataFrame, strikes: DataFrame, order: Column) -> DataFrame:
    """Sequential choice inside frames, over arrays bounded by the targets of a frame."""
    key = ["frame_time", "number"]
    size = targets.groupBy("frame_time").agg(F.count(F.lit(1)).alias("_n"))
    usable = _usable(targets, strikes, 1, None, 1, DRAWS)
    distinct = usable.groupBy(*key, "crop").agg(F.min(order).alias("pick")).join(size, "frame_time")
    rank = Window.partitionBy(*key).orderBy("pick")
    # at most len(OFFSETS) * DRAWS draws per target
    short = distinct.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= 2 * F.col("_n") + 1)
    options = short.groupBy(*key).agg(F.array_sort(F.collect_list("pick")).alias("options"))
    kind = dict(distinct.dtypes)["pick"]
    step = F.struct("number", "pos_crop", F.coalesce("options", F.array().cast(f"array<{kind}>")).alias("options"))
    lists = targets.join(options, key, "left").groupBy("frame_time").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    crop_kind = dict(targets.dtypes)["pos_crop"]
    start = F.struct(
        F.array().cast(f"array<{crop_kind}>").alias("used"),
        F.array().cast(f"array<struct<number:int,pick:{kind}>>").alias("picks"),
    )

    def choose(acc: Column, s: Column) -> Column:
        used = F.when(s["pos_crop"].isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(s["pos_crop"])))
        pick = F.try_element_at(F.filter(s["options"], lambda o: ~F.array_contains(used, o["crop"])), F.lit(1))
        return F.struct(
            F.when(pick.isNull(), used).otherwise(F.concat(used, F.array(pick["crop"]))).alias("used"),
            F.when(pick.isNull(), acc["picks"]).otherwise(
                F.concat(acc["picks"], F.array(F.struct(s["number"].alias("number"), pick.alias("pick"))))
            ).alias("picks"),
        ).cast(f"struct<used:array<{crop_kind}>,picks:array<struct<number:int,pick:{kind}>>>")

    state = F.aggregate("steps", start, choose)
    picked = lists.select("frame_time", F.explode(state["picks"]).alias("p")).select("frame_time", "p.number", "p.pick.*")
    return picked.join(targets.select(*key, "t_lat", "t_lon"), key)


def positive_patches(retained: DataFrame, frames: DataFrame) -> DataFrame:
    """Retained strikes whose crop lies in the image and is covered."""
    placed = planning.with_crop(retained.withColumn("number", F.col("number").cast("int")))
    seen = placed.join(frames.where("readable").select("frame_time", "split", "category", "dark"), "frame_time")
    return covered(seen.withColumn("_dark_table", F.col("dark"))).withColumnRenamed("_dark_table", "dark")


def active_targets(positives: DataFrame) -> DataFrame:
    return positives.select(
        "frame_time", "number", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.lit(True).alias("own"),
        "dark", F.col("crop").alias("pos_crop"),
    )


def controlled_manifest(frames: DataFrame, strikes: DataFrame, per_zero_frame: int = 2) -> DataFrame:
    """Positives at retained strikes, a matched negative each, and negatives in empty frames.

    ``frames(frame_time, split, category, readable, dark)``; ``strikes`` are in-mask ground strikes.
    Targets are frozen before any image is read; a frame whose image cannot be read gives no rows.
    """
    slotted = strikes.withColumn("frame_time", timegrid.floor_slot(F.col("ts")))
    retained = cut(selection.retained_strikes(slotted, "frame_time"))
    positives = cut(positive_patches(retained, frames))
    ring = retained.join(frames.select("frame_time", "split"), "frame_time").select(
        "split", "ts", "lat", "lon", F.col("solution_key").alias("target")
    )
    zero = frames.where("category <> 'active'")
    drawn = assign_targets(zero.select("frame_time", "split"), ring, per_zero_frame).join(
        zero.where("readable").select("frame_time", "dark"), "frame_time"
    )
    nothing = F.lit(None).cast(dict(positives.dtypes)["crop"])
    zero_targets = drawn.select(
        "frame_time", F.col("number").cast("int").alias("number"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"),
        F.lit(False).alias("own"), "dark", nothing.alias("pos_crop"),
    )
    negatives = matched_negatives(active_targets(positives).unionByName(zero_targets), strikes)
    rows = positives.select("frame_time", "number", F.lit(1).alias("label"), "lat", "lon", "x", "y", "crop").unionByName(
        negatives.select(
            "frame_time", "number", F.lit(0).alias("label"), "lat", "lon", "x", "y", "crop", "match_level",
            F.col("t_lat").alias("matched_target_lat"), F.col("t_lon").alias("matched_target_lon"),
        ), allowMissingColumns=True,
    )
    return planning.with_geometry(rows.join(frames.select("frame_time", "split", "category"), "frame_time"))


def natural_grid(frames: DataFrame, mask=geo.MASK, size: int = SIZE, step: int = SIZE) -> DataFrame:
    """Every grid centre of each frame."""
    half = size // 2
    centres = frames.withColumn(
        "y", F.explode(F.sequence(F.lit(half), F.lit(mask.height - half), F.lit(step)))
    ).withColumn("x", F.explode(F.sequence(F.lit(half), F.lit(mask.width - half), F.lit(step))))
    lat, lon = geo.to_lonlat(F.col("x"), F.col("y"), mask)
    return centres.withColumns({"lat": lat, "lon": lon, "crop": geo.crop(F.col("x"), F.col("y"), size)})


def natural_labels(frames: DataFrame, strikes: DataFrame) -> DataFrame:
    """Grid patches as positive, negative or ambiguous; uncovered patches are left out.

    A frame whose image cannot be read is one row with the outcome ``failed``, at x = y = -1.
    """
    cells = covered(natural_grid(frames.where("readable")).where(geo.crop_inside(F.col("crop"))))
    tests = F.array(
        F.struct(F.lit("hit").alias("w"), F.lit(0).alias("a"), F.lit(10).alias("b"), F.lit(0.0).alias("m")),
        F.struct(F.lit("near").alias("w"), *[F.lit(v).alias(n) for n, v in zip("abm", NEGATIVE_WINDOW)]),
    )
    tested = joins.patch_clear(
        cells.withColumn("q", F.explode(tests)), strikes, F.col("q.a"), F.col("q.b"), F.col("q.m")
    )
    both = tested.groupBy("frame_time", "x", "y").agg(
        F.max(F.when(F.col("q.w") == "hit", F.col("inside_count"))).alias("hits"),
        F.max(F.when(F.col("q.w") == "near", F.col("inside_count"))).alias("near"),
    )
    labelled = both.withColumn(
        "outcome", F.when(F.col("hits") > 0, "positive").when(F.col("near") > 0, "ambiguous").otherwise("negative")
    )
    failed = frames.where("not readable").select(
        "frame_time", F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("near"),
        F.lit("failed").alias("outcome"),
    )
    return labelled.unionByName(failed)


# columns of parts of the study area, so that the parts of a row are the bits of one number
COLUMNS = 60


def _rows_of(mask) -> tuple[float, int]:
    """Side of a part in degrees and the number of rows of parts."""
    side = (mask.lon_max - mask.lon_min) / COLUMNS
    return side, math.ceil((mask.lat_max - mask.lat_min) / side)


def near_parts(frames: DataFrame, strikes: DataFrame, start_min: int, end_min: int, km: float, radius: float = geo.RADIUS_KM_V1, mask=geo.MASK) -> DataFrame:
    """(frame_time, near): per row of parts the bits of those that lie whole within ``km`` of an event of the window.

    One event stands for its part and ten minutes, so that crowds cost no more; what it leaves open is
    still tested exactly.
    """
    side, rows = _rows_of(mask)
    turn, lat, lon = km / radius, F.col("lat"), F.col("lon")
    spot = [timegrid.slot_number(F.col("ts")).alias("s"), F.floor((lat - mask.lat_min) / side).alias("a"), F.floor((lon - mask.lon_min) / side).alias("o")]
    events = strikes.where("abs(lat) <= 90 and abs(lon) <= 360").groupBy(*spot).agg(F.min(F.struct("ts", "lat", "lon")).alias("e")).select("e.*")

    def row(value: Column) -> Column:
        return F.floor((value - mask.lat_min) / side).cast("int")

    spread = events.withColumns({
        "_a": F.greatest(row(lat - math.degrees(turn)), F.lit(0)), "_b": F.least(row(lat + math.degrees(turn)), F.lit(rows - 1)),
    }).where("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    low, high = F.lit(mask.lat_min) + F.col("row") * side, F.lit(mask.lat_min) + (F.col("row") + 1) * side
    up = F.sin(F.radians(F.greatest(F.abs(low - lat), F.abs(high - lat))) / 2)
    lean = F.cos(F.radians(lat)) * F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.greatest(F.cos(F.radians(low)), F.cos(F.radians(high))))
    room = F.lit(math.sin(turn / 2) ** 2) - up * up
    wide = F.degrees(F.asin(F.sqrt(F.least(room / lean, F.lit(1.0)))) * 2) - 1e-6
    first = F.greatest(F.ceil((lon - wide - mask.lon_min) / side), F.lit(0)).cast("int")
    last = F.least(F.floor((lon + wide - mask.lon_min) / side) - 1, F.lit(COLUMNS - 1)).cast("int")
    reach = spread.where(room > 0).select("ts", "row", first.alias("c"), (last - first + 1).alias("n")).where("n > 0")
    one = F.lit(1).cast("bigint")
    run = F.call_function("shiftleft", one, F.col("n")) - 1
    spans = reach.select("ts", "row", F.call_function("shiftleft", run, F.col("c")).alias("bits"))
    # events of one instant reach a row together
    spans = cut(spans.groupBy("ts", "row").agg(F.bit_or("bits").alias("bits")))
    found = joins.window_join(frames.select("frame_time").distinct(), spans, start_min, end_min)
    masks = found.groupBy("frame_time", "row").agg(F.bit_or("bits").alias("bits"))
    held = masks.groupBy("frame_time").agg(F.map_from_entries(F.collect_list(F.struct("row", "bits"))).alias("_held"))
    return held.select("frame_time", F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: F.coalesce(F.try_element_at("_held", k), F.lit(0).cast("bigint"))
    ).alias("near"))


def _open_parts(mask) -> Column:
    """Whether a frame's ``near`` leaves a part open in which a centre can be drawn."""
    side, rows = _rows_of(mask)
    half, tall, wide = SIZE // 2, mask.lat_max - mask.lat_min, mask.lon_max - mask.lon_min

    def part(degrees: float, most: int) -> int:
        return min(max(math.floor(degrees / side), 0), most - 1)

    top, bottom = part(tall * (1 - half / (mask.height - 1)) + 1e-9, rows), part(tall * (1 - (mask.height - half) / (mask.height - 1)) - 1e-9, rows)
    left, right = part(wide * half / (mask.width - 1) - 1e-9, COLUMNS), part(wide * (mask.width - half) / (mask.width - 1) + 1e-9, COLUMNS)
    wanted = F.lit(sum(1 << c for c in range(left, right + 1))).cast("bigint")
    return F.exists(F.slice("near", bottom + 1, top - bottom + 1), lambda bits: bits.bitwiseAND(wanted) != wanted)


def random_negatives(
    frames: DataFrame, strikes: DataFrame, quota: int, attempts: int, min_km: float = 30.0, seed: str = "rn", mask=geo.MASK
) -> DataFrame:
    """First ``quota`` random centres per frame that are far from the frame's strikes and covered.

    Attempts are drawn in growing batches for the frames that still lack centres. Draws in a part of the
    area that lies whole within ``min_km`` of a strike fail, and are dropped before they are tested.
    """
    half, found, low = SIZE // 2, None, 1
    side, rows = _rows_of(mask)
    near = near_parts(frames.where("readable"), strikes, 0, 10, min_km, mask=mask)
    waiting = frames.where("readable").join(near, "frame_time", "left")
    waiting = cut(waiting.where(F.col("near").isNull() | _open_parts(mask)))
    batch = 4 * quota
    while True:
        high = min(low + batch - 1, attempts)
        drawn = dealt(waiting).withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high))))
        key = [F.unix_seconds("frame_time"), F.col("attempt")]
        drawn = drawn.withColumns({
            "x": (F.floor(uniform(f"{seed}x", *key) * (mask.width - 2 * half)) + half).cast("int"),
            "y": (F.floor(uniform(f"{seed}y", *key) * (mask.height - 2 * half)) + half).cast("int"),
        })
        lat, lon = geo.to_lonlat(F.col("x"), F.col("y"), mask)
        row = F.least(F.greatest(F.floor((F.col("lat") - mask.lat_min) / side), F.lit(0)), F.lit(rows - 1)).cast("int")
        column = F.least(F.greatest(F.floor((F.col("lon") - mask.lon_min) / side), F.lit(0)), F.lit(COLUMNS - 1)).cast("int")
        is_near = F.coalesce(F.getbit(F.try_element_at("near", row + 1), column) == 1, F.lit(False))
        placed = drawn.withColumns({"lat": lat, "lon": lon}).where(~is_near).drop("near").withColumn("crop", geo.crop(F.col("x"), F.col("y"), SIZE))
        good = joins.min_distance_filter(covered(placed), strikes, 0, 10, min_km)
        good = cut(good.select("frame_time", "attempt", "x", "y", "lat", "lon"))
        found = good if found is None else found.unionByName(good)
        if high >= attempts:
            break
        enough = found.groupBy("frame_time").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= quota)
        waiting = cut(waiting.join(enough, "frame_time", "left_anti"))
        if waiting.isEmpty():
            break
        low, batch = high + 1, batch * 5
    return take_per_group(found, ["frame_time"], ["attempt"], quota)


def metadata_negatives(positives: DataFrame, days: DataFrame, ratio: int = 3, per_day: int = 10) -> DataFrame:
    """Synthetic rows on event-free days with the moments and kind mix of the positives.

    Place and amplitude are normal draws (Box-Muller over hashed uniforms); the number is
    ``min(ratio * positives, per_day * days)``, dealt to the days in turn.
    """
    moments = positives.agg(
        F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.greatest(F.stddev_pop("lat"), F.lit(0.5)).alias("lat_sd"), F.greatest(F.stddev_pop("lon"), F.lit(0.5)).alias("lon_sd"),
        F.greatest(F.stddev_pop("amplitude") / 3.0, F.lit(1.5)).alias("amp_sd"),
        F.avg((F.col("kind") == "Cloud").cast("double")).alias("cloud_share"),
    ).first()
    ranked = global_rank(days.select("date"), [], ["date"], "_d")
    total = ranked.count()
    count = min(ratio * moments["n"], per_day * total)
    # day d gets the numbers d, d + total, d + 2 total, ... below count
    rows = ranked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_day - 1)))).withColumn(
        "i", F.col("i") * total + F.col("_d") - 1
    ).where(F.col("i") < count)

    def normal(seed: str) -> Column:
        u1 = F.greatest(uniform(f"{seed}a", "i"), F.lit(1e-12))
        return F.sqrt(F.ln(u1) * -2.0) * F.cos(uniform(f"{seed}b", "i") * (2.0 * math.pi))

    amp = F.least(F.greatest(normal("am") * moments["amp_sd"], F.lit(-20.0)), F.lit(20.0))
    return rows.select(
        "i", F.lit(0).alias("label"), "date", (normal("la") * moments["lat_sd"] + moments["lat"]).alias("lat"),
        (normal("lo") * moments["lon_sd"] + moments["lon"]).alias("lon"), amp.alias("amplitude"),
        F.when(uniform("kd", "i") < moments["cloud_share"], "Cloud").otherwise("Ground").alias("kind"),
    )


def metadata_dataset(positives: DataFrame, days: DataFrame, seed: str = "meta") -> DataFrame:
    """Positives and synthetic negatives, shuffled by hash and split by position."""
    negatives = metadata_negatives(positives, days).withColumn("key", F.concat(F.lit("n"), F.col("i").cast("string")))
    rows = positives.select(
        F.concat(F.lit("p"), "solution_key").alias("key"), F.lit(1).alias("label"), F.to_date("ts").alias("date"), "lat", "lon",
        "amplitude", "kind",
    ).unionByName(negatives.drop("i"))
    return planning.split_by_position(rows, seed, "key")
