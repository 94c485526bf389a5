"""Spatiotemporal joins between frames or patch centres and events.

Interval joins are equi-joins on ten-minute bins plus the exact time test. Box and
nearest-event lookups go through a summary of the events per (bin, 0.75-degree cell) whose
row nests the occupied 0.02-degree sub-cells with their true extents: whole sub-cells are
counted or discarded by their extent, and single events are read only for the sub-cells an
edge cuts through (or that may hold the nearest event). Inside one sub-cell that an edge cuts,
each distinct query still meets each distinct event. Nearest-event queries try the cells around
them first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo, timegrid
from skyledger.session import cut

CELL, SUB = 0.75, 0.02
QUERY = ["frame_time", "lat", "lon", "start_min", "end_min", "margin_km"]
SLACK_KM = 1e-6


def window_join(
    frames: DataFrame, strikes: DataFrame, start_min: int, end_min: int, left_open: bool = False
) -> DataFrame:
    """Pairs of frame and event with the event in ``[t+a, t+b)``, or ``(t+a, t+b]``."""
    t0 = timegrid.plus_minutes(F.col("frame_time"), start_min)
    t1 = timegrid.plus_minutes(F.col("frame_time"), end_min)
    bins = frames.withColumns({"_t0": t0, "_t1": t1}).withColumn(
        "_bin", F.explode(F.sequence(timegrid.slot_number(F.col("_t0")), timegrid.slot_number(F.col("_t1"))))
    )
    events = strikes.withColumn("_bin", timegrid.slot_number(F.col("ts")))
    if left_open:
        inside = (F.col("ts") > F.col("_t0")) & (F.col("ts") <= F.col("_t1"))
    else:
        inside = (F.col("ts") >= F.col("_t0")) & (F.col("ts") < F.col("_t1"))
    return bins.join(events, "_bin").where(inside).drop("_bin", "_t0", "_t1")


def window_counts(frames: DataFrame, strikes: DataFrame, start_min: int, end_min: int, left_open: bool = False) -> DataFrame:
    """Events per frame window; events are counted per instant before the join."""
    instants = strikes.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"))
    hits = window_join(frames.select("frame_time").distinct(), instants, start_min, end_min, left_open)
    counts = hits.groupBy("frame_time").agg(F.sum("_n").alias("strike_count"))
    return frames.join(counts, "frame_time", "left").withColumn("strike_count", F.coalesce("strike_count", F.lit(0)))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def _points(strikes: DataFrame) -> DataFrame:
    """Distinct (instant, place) with its number of copies, bin, cell and sub-cell."""
    return _placed(strikes.groupBy("ts", "lat", "lon").agg(F.count(F.lit(1)).alias("n")))


def _placed(events: DataFrame) -> DataFrame:
    return events.select(
        timegrid.slot_number(F.col("ts")).alias("bin"), _cell(F.col("lat"), CELL).alias("cy"),
        _cell(F.col("lon"), CELL).alias("cx"), _cell(F.col("lat"), SUB).alias("sy"),
        _cell(F.col("lon"), SUB).alias("sx"), F.unix_micros("ts").alias("t"),
        F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "n",
    )


def _extent(prefix: str = "") -> list[Column]:
    columns = {"lat": ("lat_lo", "lat_hi"), "lon": ("lon_lo", "lon_hi"), "t": ("t_lo", "t_hi")}
    source = {"lat": ("p_lat", "p_lat"), "lon": ("p_lon", "p_lon"), "t": ("t", "t")} if not prefix else columns
    out = []
    for axis, (low, high) in columns.items():
        a, b = source[axis]
        out += [F.min(a).alias(low), F.max(b).alias(high)]
    return out


def _cells(points: DataFrame) -> DataFrame:
    """Per (bin, cell): extent, count and the nested sub-cells (at most 38 x 38 of them)."""
    subs = points.groupBy("bin", "cy", "cx", "sy", "sx").agg(*_extent(), F.sum("n").alias("n"))
    nested = F.struct("sy", "sx", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "t_lo", "t_hi", "n")
    return subs.groupBy("bin", "cy", "cx").agg(
        *_extent("nested"), F.sum("n").alias("n"), F.collect_list(nested).alias("subs")
    )


WINDOW = ["frame_time", "start_min", "end_min"]


def _windows(asked: DataFrame) -> DataFrame:
    """Distinct windows, one row per ten-minute bin they touch."""
    return asked.select(*WINDOW).distinct().withColumns({
        "t0": F.unix_micros(timegrid.plus_minutes(F.col("frame_time"), F.col("start_min"))),
        "t1": F.unix_micros(timegrid.plus_minutes(F.col("frame_time"), F.col("end_min"))),
    }).withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("t0") / 600_000_000), F.floor((F.col("t1") - 1) / 600_000_000)
    )))


def _get(row: Column | None, name: str) -> Column:
    return F.col(name) if row is None else row[name]


def _inside(row: Column | None = None) -> Column:
    """The whole extent lies in the query's box and window."""
    return (
        (F.greatest(F.abs(_get(row, "lat_lo") - F.col("lat")), F.abs(_get(row, "lat_hi") - F.col("lat"))) <= F.col("dlat"))
        & (F.greatest(F.abs(_get(row, "lon_lo") - F.col("lon")), F.abs(_get(row, "lon_hi") - F.col("lon"))) <= F.col("dlon"))
        & (_get(row, "t_lo") >= F.col("t0")) & (_get(row, "t_hi") < F.col("t1"))
    )


def _outside(row: Column | None = None) -> Column:
    return (
        (_get(row, "lat_lo") - F.col("lat") > F.col("dlat")) | (F.col("lat") - _get(row, "lat_hi") > F.col("dlat"))
        | (_get(row, "lon_lo") - F.col("lon") > F.col("dlon")) | (F.col("lon") - _get(row, "lon_hi") > F.col("dlon"))
        | (_get(row, "t_hi") < F.col("t0")) | (_get(row, "t_lo") >= F.col("t1"))
    )


def box_counts(candidates: DataFrame, strikes: DataFrame, size: int = 64, degrees_per_pixel: float = 0.02) -> DataFrame:
    """``inside_count`` per distinct query: events in the widened patch box and time window."""
    points = _points(strikes)
    dlat, dlon = geo.box_half_degrees(F.col("lat"), size, degrees_per_pixel, F.col("margin_km"))
    queries = candidates.select(*QUERY).distinct().withColumns({"dlat": dlat, "dlon": dlon})
    cells = _windows(candidates).join(_cells(points), "bin")
    eps = 1e-9

    def span(value: str, half: str) -> Column:
        return F.sequence(
            F.floor((F.col(value) - F.col(half) - eps) / CELL).cast("int"),
            F.floor((F.col(value) + F.col(half) + eps) / CELL).cast("int"),
        )

    spread = queries.withColumn("cy", F.explode(span("lat", "dlat"))).withColumn("cx", F.explode(span("lon", "dlon")))
    hit = spread.join(cells, [*WINDOW, "cy", "cx"]).where(~_outside())
    sure = F.when(_inside(), F.col("n")).otherwise(
        F.aggregate(
            F.filter("subs", lambda s: _inside(s)), F.lit(0).cast("bigint"), lambda acc, s: acc + s["n"]
        )
    )
    cut_subs = F.filter("subs", lambda s: ~_inside(s) & ~_outside(s))
    cut_subs = F.when(_inside(), F.array().cast("array<struct<sy:int,sx:int>>")).otherwise(
        F.transform(cut_subs, lambda s: F.struct(s["sy"].alias("sy"), s["sx"].alias("sx")))
    )
    keep = [*QUERY, "dlat", "dlon", "t0", "t1", "bin"]
    parts = hit.select(*keep, sure.alias("sure"), cut_subs.alias("cut"))
    whole = parts.groupBy(*QUERY).agg(F.sum("sure").alias("c"))
    edges = parts.where(F.size("cut") > 0).select(*keep, F.explode("cut").alias("s")).select(*keep, "s.sy", "s.sx")
    exact = edges.join(points.drop("cy", "cx"), ["bin", "sy", "sx"]).where(
        (F.abs(F.col("p_lat") - F.col("lat")) <= F.col("dlat")) & (F.abs(F.col("p_lon") - F.col("lon")) <= F.col("dlon"))
        & (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))
    ).groupBy(*QUERY).agg(F.sum("n").alias("c"))
    return whole.unionByName(exact).groupBy(*QUERY).agg(F.sum("c").alias("inside_count"))


def patch_clear(
    candidates: DataFrame, strikes: DataFrame, start_min, end_min, margin_km, size: int = 64,
    degrees_per_pixel: float = 0.02,
) -> DataFrame:
    """Adds ``inside_count`` and ``clear``; a centre with no event in its window is clear."""
    asked = with_query(candidates, start_min, end_min, margin_km)
    counts = box_counts(asked, strikes, size, degrees_per_pixel)
    count = F.coalesce("inside_count", F.lit(0))
    return asked.join(counts, QUERY, "left").withColumn("inside_count", count).withColumn(
        "clear", F.col("inside_count") == 0
    )


def with_query(candidates: DataFrame, start_min, end_min, margin_km) -> DataFrame:
    def column(v, kind):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return candidates.withColumns({
        "start_min": column(start_min, "int"), "end_min": column(end_min, "int"), "margin_km": column(margin_km, "double"),
    })


#: Places that a cell of a window's grid holds on average at least, and those from which it counts as crowded.
FULL, CROWD = 2, 64


def _neighbours(y: Column, x: Column) -> Column:
    """A cell and the eight around it."""
    return F.explode(F.array(*[F.struct((y + a).alias("gy"), (x + b).alias("gx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))


def _nearest_around(queries: DataFrame, strikes: DataFrame, radius: float) -> DataFrame:
    """(``QUERY``, b): the nearest event of queries that find one nearer than all that lies outside of the nine cells around them.

    Each window has a grid as fine as its places are dense. Queries beside a crowded cell are left out.
    """
    points = _points(strikes).where("p_lat is not null and p_lon is not null")
    inside = _windows(queries).join(points, "bin").where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")))
    # of the events at one place the first is the nearest
    places = cut(inside.groupBy(*WINDOW, "p_lat", "p_lon").agg(F.min("t").alias("t")))
    wide = F.greatest((F.col("lat_hi") - F.col("lat_lo")) * (F.col("lon_hi") - F.col("lon_lo")), F.lit(SUB * SUB))
    step = F.lit(SUB) * F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.sqrt(wide * FULL / F.col("n")) / SUB)), F.lit(0)))
    grids = places.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("n"), *[end(c).alias(f"{c[2:]}_{tag}") for c in ("p_lat", "p_lon") for tag, end in (("lo", F.min), ("hi", F.max))]
    ).where((F.col("lat_hi") <= 90) & (F.col("lat_lo") >= -90) & (F.col("lon_hi") <= 360) & (F.col("lon_lo") >= -360))
    grids = cut(grids.select(*WINDOW, "lon_lo", "lon_hi", step.alias("step")))

    def cell(value: str) -> Column:
        return F.floor(F.col(value) / F.col("step"))

    placed = places.join(grids.select(*WINDOW, "step"), WINDOW).select(*WINDOW, cell("p_lat").alias("gy"), cell("p_lon").alias("gx"), "t", "p_lat", "p_lon")
    grid = [*WINDOW, "gy", "gx"]
    crowds = cut(placed.groupBy(*grid).count().where(F.col("count") >= CROWD).select(*grid))
    beside = crowds.select(*WINDOW, _neighbours(F.col("gy"), F.col("gx")).alias("c")).select(*WINDOW, "c.*").distinct()
    calm = placed.join(crowds, grid, "left_anti").groupBy(*grid).agg(F.collect_list(F.struct("t", "p_lat", "p_lon")).alias("places"))
    own = queries.join(grids, WINDOW).withColumns({"gy": cell("lat"), "gx": cell("lon")}).join(beside, grid, "left_anti")
    lat, lon = F.col("lat"), F.col("lon")
    up = F.least(lat - (F.col("gy") - 1) * F.col("step"), (F.col("gy") + 2) * F.col("step") - lat)
    along = F.least(lon - (F.col("gx") - 1) * F.col("step"), (F.col("gx") + 2) * F.col("step") - lon, F.lit(90.0))
    # what lies outside of the nine cells is beyond a parallel or a meridian; none is reached the other way round
    clear = F.least(F.radians(up), F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(along)))) * radius
    once = F.greatest(F.abs(lon - F.col("lon_lo")), F.abs(lon - F.col("lon_hi"))) <= 180
    spread = own.where(once & (F.abs(lat) <= 90)).withColumns({"clear": clear, "_c": _neighbours(F.col("gy"), F.col("gx"))}).select(*QUERY, "clear", "_c.*")
    found = spread.join(calm, grid).select(*QUERY, "clear", F.array_min(F.transform("places", lambda p: F.struct(
        geo.haversine(p["p_lat"], p["p_lon"], F.col("lat"), F.col("lon"), radius).alias("km"), p["t"].alias("t"), p["p_lat"].alias("p_lat"), p["p_lon"].alias("p_lon"),
    ))).alias("b"))
    best = found.groupBy(*QUERY).agg(F.min("b").alias("b"), F.min("clear").alias("clear"))
    return best.where(F.col("b.km") < F.col("clear") - SLACK_KM).select(*QUERY, "b")


def nearest(asked: DataFrame, strikes: DataFrame, radius: float = geo.RADIUS_KM) -> DataFrame:
    """Distance and signed minutes of the nearest event in the window, per distinct query.

    Most queries find it in the cells around them; the others search the whole window.
    """
    queries = asked.select(*QUERY).distinct()
    around = cut(_nearest_around(queries, strikes, radius))
    left = cut(queries.join(around, QUERY, "left_anti"))
    best = around if left.isEmpty() else around.unionByName(_nearest_of_all(left, strikes, radius))
    return best.select(
        *QUERY, F.col("b.km").alias("nearest_distance_km"),
        ((F.col("b.t") - F.unix_micros("frame_time")) / 60_000_000.0).alias("nearest_minutes"),
    )


def _nearest_of_all(queries: DataFrame, strikes: DataFrame, radius: float) -> DataFrame:
    """(``QUERY``, b): the nearest event of the window.

    Branch and bound: cells and then sub-cells whose lower distance bound exceeds the best
    upper bound of the query are dropped before single events are read. A window's cells, and a
    cell's sub-cells, are arrays that a query filters in its own row; only what is kept becomes rows.
    """
    points = _points(strikes)
    nested = cut(_cells(points))
    windows = _windows(queries)
    extent = F.struct("bin", "cy", "cx", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "t_lo", "t_hi")
    cells = windows.join(nested.drop("subs", "n"), "bin").groupBy(*WINDOW, "t0", "t1").agg(F.collect_list(extent).alias("cells"))

    def kept(array: str) -> Column:
        """Parts of the array that may hold the nearest event."""
        def bounded(c: Column) -> Column:
            lower, upper = geo.box_distance_bounds(F.col("lat"), F.col("lon"), *[c[e] for e in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")], radius)
            # an upper bound only counts when the extent surely holds an event of the window
            sure = (c["t_lo"] >= F.col("t0")) & (c["t_hi"] < F.col("t1"))
            return F.struct(c.alias("c"), lower.alias("lower"), F.when(sure, upper).alias("upper"))

        live = F.filter(array, lambda c: (c["t_hi"] >= F.col("t0")) & (c["t_lo"] < F.col("t1")))
        def within(rows: Column, best: Column) -> Column:
            return F.filter(rows, lambda x: best.isNull() | (x["lower"] <= best + SLACK_KM))

        # lambdas bind the bounds and the best of them, so that each is found once
        return F.flatten(F.transform(F.array(F.transform(live, bounded)), lambda rows: F.flatten(F.transform(
            F.array(F.array_min(F.transform(rows, lambda x: x["upper"]))),
            lambda best: F.transform(within(rows, best), lambda x: x["c"]),
        ))))

    base = [*QUERY, "t0", "t1", "bin"]
    near = queries.join(cells, WINDOW).withColumn("c", F.explode(kept("cells"))).select(
        *QUERY, "t0", "t1", "c.bin", "c.cy", "c.cx")
    inner = near.join(nested.select("bin", "cy", "cx", "subs"), ["bin", "cy", "cx"])
    subs = inner.withColumn("s", F.explode(kept("subs"))).select(*base, "s.sy", "s.sx")
    km = geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"), radius)
    found = subs.join(points, ["bin", "sy", "sx"]).where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")))
    return found.groupBy(*QUERY).agg(F.min(F.struct(km.alias("km"), "t", "p_lat", "p_lon")).alias("b"))


def nearest_strike(candidates: DataFrame, strikes: DataFrame, start_min, end_min, radius: float = geo.RADIUS_KM) -> DataFrame:
    asked = with_query(candidates, start_min, end_min, 0.0)
    return asked.join(nearest(asked, strikes, radius), QUERY, "left")


def min_distance_filter(
    candidates: DataFrame, strikes: DataFrame, start_min, end_min, km: float, radius: float = geo.RADIUS_KM_V1
) -> DataFrame:
    """Centres at least ``km`` away from every event of their window.

    A query meets the cells within its radius only. A cell or sub-cell that surely holds a near
    event settles it; sub-cells are judged as an array in the cell's row, and single events are read
    only for those that the circle of a query cuts which no cell has settled.
    """
    asked = with_query(candidates, start_min, end_min, 0.0)
    points, turn = _points(strikes), km / radius
    lean = F.cos(F.radians(F.col("lat")))
    wide = F.when(lean <= math.sin(turn), F.lit(180.0)).otherwise(F.degrees(F.asin(F.lit(math.sin(turn)) / lean)))
    eps = 1e-9

    def span(value: str, half: Column) -> Column:
        return F.sequence(F.floor((F.col(value) - half - eps) / CELL).cast("int"), F.floor((F.col(value) + half + eps) / CELL).cast("int"))

    spread = asked.select(*QUERY).distinct().withColumn("cy", F.explode(span("lat", F.lit(math.degrees(turn))))).withColumn(
        "cx", F.explode(span("lon", wide)))
    cells = spread.join(_windows(asked).join(_cells(points), "bin"), [*WINDOW, "cy", "cx"])

    def judged(part: Column | None = None) -> tuple[Column, Column]:
        """Whether an extent may hold a near event of the window, and whether it surely does."""
        lower, upper = geo.box_distance_bounds(F.col("lat"), F.col("lon"), *[_get(part, c) for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")], radius)
        t_lo, t_hi = _get(part, "t_lo"), _get(part, "t_hi")
        may = (t_hi >= F.col("t0")) & (t_lo < F.col("t1")) & (lower < km + SLACK_KM)
        return may, (t_lo >= F.col("t0")) & (t_hi < F.col("t1")) & (upper < km - SLACK_KM)

    base = [*QUERY, "t0", "t1", "bin"]
    may, sure = judged()
    near = sure | F.exists("subs", lambda s: judged(s)[1])
    cut_by_circle = F.transform(F.filter("subs", lambda s: judged(s)[0]), lambda s: F.struct(s["sy"].alias("sy"), s["sx"].alias("sx")))
    seen = cut(cells.where(may).withColumn("_near", near).select(*base, "_near", F.when(~F.col("_near"), cut_by_circle).alias("_open")))
    settled = seen.where("_near").select(*QUERY).distinct()
    # what one cell has settled needs no single events of the others
    parts = seen.where("not _near").join(settled, QUERY, "left_anti").select(*base, F.explode("_open").alias("s")).select(*base, "s.*")
    distance = geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"), radius)
    single = parts.join(points, ["bin", "sy", "sx"]).where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1")) & (distance < km))
    blocked = settled.unionByName(single.select(*QUERY)).distinct()
    return asked.join(blocked, QUERY, "left_anti")


def _sure_cells(frames: DataFrame, cells: DataFrame, windows: list[tuple[str, int, int, float]]) -> DataFrame:
    """Per frame, a map from the number of each window to extents of cells whose events of some bins all lie in it.

    The bins of a cell are merged, so the size depends on the area and not on the number of events.
    """
    numbered = F.array(*[
        F.struct(F.lit(i).alias("w"), F.lit(a).alias("start_min"), F.lit(b).alias("end_min")) for i, (_, a, b, _m) in enumerate(windows)
    ])
    asked = frames.withColumn("_w", F.explode(numbered)).select("frame_time", "_w.*")
    spans = asked.join(_windows(asked), WINDOW).join(cells, "bin").where((F.col("t_lo") >= F.col("t0")) & (F.col("t_hi") < F.col("t1")))
    merged = spans.groupBy("frame_time", "w", "cy", "cx").agg(*_extent("merged")[:4])
    held = merged.groupBy("frame_time", "w").agg(F.collect_list(F.struct("lat_lo", "lat_hi", "lon_lo", "lon_hi")).alias("held"))
    return held.groupBy("frame_time").agg(F.map_from_entries(F.collect_list(F.struct("w", "held"))).alias("_held"))


def _covers(part: Column, dlat: Column, dlon: Column) -> Column:
    lat, lon = F.col("lat"), F.col("lon")
    return (
        (F.abs(part["lat_lo"] - lat) <= dlat) & (F.abs(part["lat_hi"] - lat) <= dlat)
        & (F.abs(part["lon_lo"] - lon) <= dlon) & (F.abs(part["lon_hi"] - lon) <= dlon)
    )


def surely_hit(
    places: DataFrame, cells: DataFrame, windows: list[tuple[str, int, int, float]], size: int = 64, degrees_per_pixel: float = 0.02
) -> DataFrame:
    """``places`` with ``sure``: for each window, whether a whole cell of events lies in the box."""
    held = _sure_cells(places.select("frame_time").distinct(), cells, windows)

    def sure(i: int, margin: float) -> Column:
        half = geo.box_half_degrees(F.col("lat"), size, degrees_per_pixel, F.lit(float(margin)))
        return F.coalesce(F.exists(F.col("_held")[i], lambda c: _covers(c, *half)), F.lit(False))

    return places.join(held, "frame_time", "left").select(
        *places.columns, F.array(*[sure(i, m) for i, (_, _a, _b, m) in enumerate(windows)]).alias("sure")
    )


def contamination_audit(
    negatives: DataFrame, strikes: DataFrame, windows: list[tuple[str, int, int, float]], size: int = 64, degrees_per_pixel: float = 0.02
) -> DataFrame:
    """Negatives hit under each named window.

    One event in the box is enough, so nothing is counted: a whole cell, then a whole sub-cell inside
    the box settles a place, and single events are read only for places that no cell has settled.
    """
    nested = cut(_cells(_placed(strikes.withColumn("n", F.lit(1)))))
    flagged = cut(surely_hit(negatives.select("frame_time", "lat", "lon"), nested.drop("subs", "n"), windows, size, degrees_per_pixel))
    places = flagged.where(F.exists("sure", lambda s: ~s)).groupBy("frame_time", "lat", "lon", "sure").agg(F.count(F.lit(1)).alias("copies"))
    table = F.array(*[
        F.struct(
            F.lit(i).alias("w"), F.lit(a).alias("start_min"), F.lit(b).alias("end_min"), F.lit(float(m)).alias("margin_km"),
            F.col("sure")[i].alias("sure"),
        ) for i, (_, a, b, m) in enumerate(windows)
    ])
    tested = places.select("frame_time", "lat", "lon", "copies", F.explode(table).alias("_w")).select(
        "frame_time", "lat", "lon", "copies", "_w.*").where("not sure")

    dlat, dlon = geo.box_half_degrees(F.col("lat"), size, degrees_per_pixel, F.col("margin_km"))
    eps = 1e-9

    def span(value: str, half: str) -> Column:
        return F.sequence(
            F.floor((F.col(value) - F.col(half) - eps) / CELL).cast("int"),
            F.floor((F.col(value) + F.col(half) + eps) / CELL).cast("int"),
        )

    key = ["frame_time", "lat", "lon", "w", "copies"]
    base = [*key, "dlat", "dlon", "t0", "t1", "bin"]
    asked = tested.withColumns({
        "dlat": dlat, "dlon": dlon,
        "t0": F.unix_micros(timegrid.plus_minutes(F.col("frame_time"), F.col("start_min"))),
        "t1": F.unix_micros(timegrid.plus_minutes(F.col("frame_time"), F.col("end_min"))),
    })
    spread = (
        asked.withColumn("bin", F.explode(F.sequence(F.floor(F.col("t0") / 600_000_000), F.floor((F.col("t1") - 1) / 600_000_000))))
        .withColumn("cy", F.explode(span("lat", "dlat"))).withColumn("cx", F.explode(span("lon", "dlon"))).select(*base, "cy", "cx")
    )
    near = F.exists("subs", lambda s: _inside(s))
    edge = F.transform(
        F.filter("subs", lambda s: ~_inside(s) & ~_outside(s)), lambda s: F.struct(s["sy"].alias("sy"), s["sx"].alias("sx"))
    )
    seen = cut(
        spread.join(nested, ["bin", "cy", "cx"]).where(~_outside()).withColumn("_near", F.coalesce(near, F.lit(False)))
        .select(*base, "_near", F.when(~F.col("_near"), edge).alias("_open")).where(F.col("_near") | (F.size("_open") > 0))
    )
    settled = seen.where("_near").select(*key).distinct()
    # what one cell has settled needs no single events of the others
    same = F.lit(True)
    for c in key:
        same = same & (F.col(f"o.{c}") == F.col(f"s.{c}"))
    left = seen.where("not _near").alias("o").join(settled.alias("s"), same, "left_anti")
    parts = left.select(*base, F.explode("_open").alias("s")).select(*base, "s.sy", "s.sx")
    single = parts.join(_points(strikes).drop("cy", "cx"), ["bin", "sy", "sx"]).where(
        (F.abs(F.col("p_lat") - F.col("lat")) <= F.col("dlat")) & (F.abs(F.col("p_lon") - F.col("lon")) <= F.col("dlon"))
        & (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))
    )
    more = settled.unionByName(single.select(*key)).distinct().select("w", F.lit(0).alias("n"), F.col("copies").alias("k"))
    found = flagged.select(F.posexplode("sure").alias("w", "_sure")).select("w", F.lit(1).alias("n"), F.col("_sure").cast("bigint").alias("k"))
    names = F.array(*[F.lit(n) for n, *_ in windows])
    return found.unionByName(more).groupBy(names[F.col("w")].alias("window")).agg(
        F.sum("n").alias("negatives"), F.sum("k").alias("contaminated")
    )


def label_exists(patches: DataFrame, strikes: DataFrame, degrees: float = 0.5) -> DataFrame:
    """1 if any event lies less than ``degrees`` of latitude from the centre.

    Each latitude band only needs its lowest and highest event: the centre's own band always
    matches when occupied, the neighbours match through the event nearest to the centre.
    """
    bands = strikes.groupBy(F.floor(F.col("lat") / degrees).alias("band")).agg(
        F.min("lat").alias("low"), F.max("lat").alias("high")
    )
    centres = patches.select("lat").distinct()
    spread = centres.withColumn("band", F.explode(F.sequence(
        F.floor(F.col("lat") / degrees) - 1, F.floor(F.col("lat") / degrees) + 1
    )))
    lo, hi, c = F.col("low"), F.col("high"), F.col("lat")
    within = (
        (F.abs(lo - c) < degrees) | (F.abs(hi - c) < degrees)
        | (F.col("band") == F.floor(c / degrees))
    )
    hits = spread.join(bands, "band").where(within).select("lat").distinct().withColumn("_hit", F.lit(1))
    return patches.join(hits, "lat", "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def free_cells(occupied: DataFrame, rows: int, cols: int) -> DataFrame:
    """Grid cells without an event, for every observed time bin."""
    every = (
        occupied.select("time_bin").distinct()
        .withColumn("lat_idx", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
        .withColumn("lon_idx", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    )
    return every.join(occupied.select("time_bin", "lat_idx", "lon_idx"), ["time_bin", "lat_idx", "lon_idx"], "left_anti")


def no_event_days(strikes: DataFrame, first: str, last: str) -> DataFrame:
    days = strikes.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(first).cast("date"), F.lit(last).cast("date")
    )).alias("date"))
    return days.join(strikes.select(F.to_date("ts").alias("date")).distinct(), "date", "left_anti")


def prediction_alignment(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of counts: missing, extra and duplicate paths, and rows out of place.

    Both tables carry ``path`` and ``position``; duplicates are reduced before the join.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("path").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.min("position").alias(f"at_{tag}"))

    both = side(predictions, "p").join(side(manifest, "m"), "path", "full_outer")
    p, m = F.col("n_p"), F.col("n_m")
    return both.agg(
        F.count_if(p.isNull()).alias("missing"), F.count_if(m.isNull()).alias("extra"),
        F.sum(F.greatest(F.coalesce(p, F.lit(1)) - 1, F.lit(0))).alias("duplicate_predictions"),
        F.sum(F.greatest(F.coalesce(m, F.lit(1)) - 1, F.lit(0))).alias("duplicate_manifest"),
        F.count_if(F.col("at_p") != F.col("at_m")).alias("out_of_place"),
    )


def frozen_threshold_check(used: DataFrame, recorded: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    r = recorded.select("run_name", F.col("threshold").alias("recorded_threshold"))
    return used.join(r, "run_name", "left").withColumn(
        "match", F.coalesce(F.abs(F.col("threshold") - F.col("recorded_threshold")) <= tolerance, F.lit(False))
    )


def reported_metric_check(computed: DataFrame, reported: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Long-form metric tables compared value by value; two nulls agree."""
    c = computed.select(*keys, "metric", F.col("value").alias("computed"))
    r = reported.select(*keys, "metric", F.col("value").alias("reported"))
    both_null = F.col("computed").isNull() & F.col("reported").isNull()
    return c.join(r, [*keys, "metric"], "full_outer").withColumn(
        "match", both_null | F.coalesce(F.abs(F.col("computed") - F.col("reported")) <= tolerance, F.lit(False))
    )
