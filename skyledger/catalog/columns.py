"""Column-level queries: time, place, pixels, strings, scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyledger.catalog.base import hav, md5, query, split_sql, sql_with
from skyledger.functions import geo, timegrid
from skyledger.functions.hashing import hash_order
from skyledger.operators import planning, ranking
from skyledger.sources import adapters as A

SLOT = "time_bucket(interval '10 minutes', ts)"


@query("frame_slot", sql_with("strikes", f"select solution_key, {SLOT} as frame_time from strikes"))
def frame_slot(spark, sf):
    return A.strikes(spark, sf).select("solution_key", timegrid.floor_slot(F.col("ts")).alias("frame_time"))


@query("nowcast_slot", sql_with("strikes", """select solution_key, make_timestamp(
  (ceil((epoch_us(ts) - 3600000000) / 600000000.0::double))::bigint * 600000000) as frame_time from strikes"""))
def nowcast_slot(spark, sf):
    shifted = timegrid.plus_minutes(F.col("ts"), -60)
    return A.strikes(spark, sf).select("solution_key", timegrid.ceil_slot(shifted).alias("frame_time"))


@query("target_window", sql_with("strikes", f"""select distinct {SLOT} as frame_time, {SLOT} as window_start,
  {SLOT} + interval '10 minutes' as window_end, {SLOT} + interval '60 minutes' as nowcast_end from strikes"""))
def target_window(spark, sf):
    frames = A.strikes(spark, sf).select(timegrid.floor_slot(F.col("ts")).alias("frame_time")).distinct()
    start, end = timegrid.target_window(F.col("frame_time"))
    _, nowcast = timegrid.target_window(F.col("frame_time"), 60)
    return frames.select("frame_time", start.alias("window_start"), end.alias("window_end"), nowcast.alias("nowcast_end"))


SAT = "case when {t} >= timestamp '2022-12-13 00:00:00' then 'H09' else 'H08' end"


@query("frame_identity", f"""with f as (select distinct o_orderdate::timestamp + interval '27 years' as t from orders)
select t as frame_time, {SAT.format(t='t')} as satellite,
  case when t >= timestamp '2022-12-13 00:00:00' then 'noaa-himawari9' else 'noaa-himawari8' end as bucket,
  {SAT.format(t='t')} || '_' || strftime(t, '%Y%m%d_%H%M') as frame_id from f""")
def frame_identity(spark, sf):
    t = F.col("frame_time")
    frames = A.table(spark, sf, "orders").select(
        (F.col("o_orderdate") + F.expr("interval 27 years")).cast("timestamp").alias("frame_time")
    ).distinct()
    return frames.select(
        "frame_time", timegrid.satellite_id(t).alias("satellite"), timegrid.bucket(t).alias("bucket"),
        timegrid.frame_id(t).alias("frame_id"),
    )


OBJECTS = f"""frames as (select distinct {SLOT} as t from ground),
objects as (select t, band, seg, 'noaa-himawari9/AHI-L1b-FLDK/' || strftime(t, '%Y/%m/%d/%H%M') || '/HS_H09_' ||
  strftime(t, '%Y%m%d_%H%M') || '_' || band || '_FLDK_R20_S' || lpad(seg::varchar, 2, '0') || '10.DAT.bz2' as object_key
  from (select t, band, unnest([5, 6]) as seg from (select t, unnest(['B08', 'B13', 'B15']) as band from frames)))"""


@query("object_keys", sql_with("ground", f"""+{OBJECTS}
select t as frame_time, band, seg::int as segment, object_key from objects"""))
def object_keys(spark, sf):
    return planning.frame_objects(ground_frames(spark, sf)).select("frame_time", "band", "segment", "object_key")


def ground_frames(spark, sf):
    return A.ground(spark, sf).select(timegrid.floor_slot(F.col("ts")).alias("frame_time")).distinct()


@query("object_inventory", sql_with("ground", f"""+{OBJECTS}
select t as frame_time, object_key, '/cache/' || object_key as local_path, 'planned' as planning_status from objects"""))
def object_inventory(spark, sf):
    objects = planning.frame_objects(ground_frames(spark, sf))
    ledger = objects.groupBy("frame_time").agg(
        F.array_join(F.array_sort(F.collect_list("object_key")), ";").alias("keys")
    ).withColumn("paths", F.array_join(F.transform(F.split("keys", ";"), lambda k: F.concat(F.lit("/cache/"), k)), ";"))
    return planning.explode_in_step(ledger, "keys", "paths")


@query("split_fixed", sql_with("strikes", f"""select solution_key, {split_sql('ts')} as split_by_instant,
  case when ts::date <= date '2024-01-20' then 'train' when ts::date <= date '2024-01-26' then 'val' else 'test' end
  as split_by_date from strikes"""))
def split_fixed(spark, sf):
    ts = F.col("ts")
    return A.strikes(spark, sf).select(
        "solution_key", timegrid.split_by_instant(ts, A.TRAIN_END, A.VAL_END).alias("split_by_instant"),
        timegrid.split_by_date(ts, "2024-01-20", "2024-01-26").alias("split_by_date"),
    )


@query("split_by_time_quantile", sql_with("strikes", """+r as (select *, time_bucket(interval '1 hour', ts) as hour from strikes),
d as (select hour, row_number() over (order by hour) - 1 as i, count(*) over () as n from (select distinct hour from r)),
c as (select min(case when i = floor(0.70::double * n) then hour end) as t1, min(case when i = floor(0.85::double * n) then hour end) as t2 from d)
select solution_key, hour as time_bin, case when hour < t1 then 'train' when hour < t2 then 'val' else 'test' end as split from r, c"""))
def split_by_time_quantile(spark, sf):
    rows = A.strikes(spark, sf).select("solution_key", timegrid.floor_slot(F.col("ts"), 3600).alias("time_bin"))
    return planning.split_by_time_quantile(rows, "time_bin")


@query("split_by_position", sql_with("strikes", f"""+r as (select solution_key,
  row_number() over (order by {md5('shuffle', 'solution_key')}, solution_key) as position, count(*) over () as n from strikes)
select solution_key, position, case when position <= floor(0.7::double * n) then 'train'
  when position <= floor(0.85::double * n) then 'val' else 'test' end as split from r"""))
def split_by_position(spark, sf):
    rows = A.strikes(spark, sf).select("solution_key")
    return planning.split_by_position(rows, "shuffle", "solution_key")


@query("grid_cell", sql_with("strikes", """select solution_key,
  least(greatest(floor((lat - 1.2::double) / 0.5::double), 0), 10)::int as lat_idx,
  least(greatest(floor((lon - 99.7::double) / 0.5::double), 0), 8)::int as lon_idx,
  round(1.2::double + (least(greatest(floor((lat - 1.2::double) / 0.5::double), 0), 10) + 0.5::double) * 0.5::double, 6) as latitude,
  round(99.7::double + (least(greatest(floor((lon - 99.7::double) / 0.5::double), 0), 8) + 0.5::double) * 0.5::double, 6) as longitude
  from strikes"""))
def grid_cell(spark, sf):
    m = geo.MASK
    i = geo.cell_index(F.col("lat"), m.lat_min, m.lat_max, 0.5)
    j = geo.cell_index(F.col("lon"), m.lon_min, m.lon_max, 0.5)
    return A.strikes(spark, sf).select(
        "solution_key", i.alias("lat_idx"), j.alias("lon_idx"),
        F.round(geo.cell_centre(i, m.lat_min, 0.5), 6).alias("latitude"),
        F.round(geo.cell_centre(j, m.lon_min, 0.5), 6).alias("longitude"),
    )


@query("grid_label", sql_with("strikes", """select solution_key, floor((lat - 1.2::double) / 0.5::double)::bigint::varchar
  || '_' || floor((lon - 99.7::double) / 0.5::double)::bigint::varchar as grid_cell from strikes"""))
def grid_label(spark, sf):
    return A.strikes(spark, sf).select("solution_key", geo.grid_label(F.col("lat"), F.col("lon")).alias("grid_cell"))


@query("time_features", sql_with("strikes", """select solution_key, month(ts)::int as month, hour(ts)::int as hour,
  dayofyear(ts)::int as day_of_year, ((month(ts) % 12) // 3)::int as season from strikes"""))
def time_features(spark, sf):
    ts = F.col("ts")
    return A.strikes(spark, sf).select(
        "solution_key", F.month(ts).alias("month"), F.hour(ts).alias("hour"),
        F.dayofyear(ts).alias("day_of_year"), timegrid.season(F.month(ts)).alias("season"),
    )


@query("cyclic_features", sql_with("strikes", """+h as (select solution_key, (hour(ts) + 8) % 24 as h, month(ts) as m from strikes)
select solution_key, round(sin(2 * pi() * h / 24.0::double), 9) as hour_sin, round(cos(2 * pi() * h / 24.0::double), 9) as hour_cos,
  round(sin(2 * pi() * (m - 1) / 12.0::double), 9) as month_sin, round(cos(2 * pi() * (m - 1) / 12.0::double), 9) as month_cos from h"""))
def cyclic_features(spark, sf):
    ts = F.col("ts")
    turn = F.lit(2 * math.pi)
    h, m = turn * timegrid.local_hour(ts) / 24.0, turn * (F.month(ts) - 1) / 12.0
    return A.strikes(spark, sf).select(
        "solution_key", F.round(F.sin(h), 9).alias("hour_sin"), F.round(F.cos(h), 9).alias("hour_cos"),
        F.round(F.sin(m), 9).alias("month_sin"), F.round(F.cos(m), 9).alias("month_cos"),
    )


BLOCK = """case when {h} < 6 then '00:00-05:59' when {h} < 12 then '06:00-11:59'
  when {h} < 18 then '12:00-17:59' else '18:00-23:59' end"""


@query("local_time_strata", sql_with("strikes", f"""+h as (select solution_key, ((hour(ts) + 8) % 24)::int as h, month(ts) as m from strikes)
select solution_key, h as local_hour, {BLOCK.format(h='h')} as local_time_block, m::varchar || '|' || (h // 4)::varchar as stratum from h"""))
def local_time_strata(spark, sf):
    ts = F.col("ts")
    hour = timegrid.local_hour(ts)
    return A.strikes(spark, sf).select(
        "solution_key", hour.alias("local_hour"), timegrid.time_block(hour).alias("local_time_block"),
        timegrid.stratum(F.month(ts), hour).alias("stratum"),
    )


PX = "round_even((lon - 99.7::double) / (104.4::double - 99.7::double) * 234, 0)::int"
PY = "round_even((6.8::double - lat) / (6.8::double - 1.2::double) * 279, 0)::int"


@query("lonlat_to_pixel", sql_with("strikes", f"select solution_key, {PX} as x, {PY} as y from strikes"))
def lonlat_to_pixel(spark, sf):
    x, y = geo.to_pixel(F.col("lat"), F.col("lon"))
    return A.strikes(spark, sf).select("solution_key", x.alias("x"), y.alias("y"))


@query("pixel_to_lonlat", sql_with("strikes", f"""+p as (select solution_key, {PX} as x, {PY} as y from strikes)
select solution_key, round(6.8::double - y / 279.0::double * (6.8::double - 1.2::double), 9) as lat,
  round(99.7::double + x / 234.0::double * (104.4::double - 99.7::double), 9) as lon from p"""))
def pixel_to_lonlat(spark, sf):
    x, y = geo.to_pixel(F.col("lat"), F.col("lon"))
    lat, lon = geo.to_lonlat(x, y)
    return A.strikes(spark, sf).select("solution_key", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("crop_bounds", sql_with("strikes", f"""+p as (select solution_key, {PX} as x, {PY} as y from strikes)
select solution_key, x - 32 as x0, y - 32 as y0, x + 32 as x1, y + 32 as y1 from p
where x - 32 >= 0 and y - 32 >= 0 and x + 32 <= 235 and y + 32 <= 280"""))
def crop_bounds(spark, sf):
    return planning.with_crop(A.strikes(spark, sf)).select("solution_key", "crop.*")


@query("crop_geometry", sql_with("strikes", f"""+p as (select *, {PX} as x, {PY} as y from strikes),
c as (select *, x - 32 as x0, y - 32 as y0, x + 32 as x1, y + 32 as y1 from p)
select solution_key, round(6.8::double - y0 / 279.0::double * (6.8::double - 1.2::double), 6) as crop_north,
  round(6.8::double - (y1 - 1) / 279.0::double * (6.8::double - 1.2::double), 6) as crop_south,
  round(99.7::double + x0 / 234.0::double * (104.4::double - 99.7::double), 6) as crop_west,
  round(99.7::double + (x1 - 1) / 234.0::double * (104.4::double - 99.7::double), 6) as crop_east,
  round(least(lat - 1.2::double, 6.8::double - lat, lon - 99.7::double, 104.4::double - lon) * 111.0::double, 6) as distance_to_boundary_km
from c where x0 >= 0 and y0 >= 0 and x1 <= 235 and y1 <= 280"""))
def crop_geometry(spark, sf):
    rows = planning.with_geometry(planning.with_crop(A.strikes(spark, sf)))
    cols = ("crop_north", "crop_south", "crop_west", "crop_east", "distance_to_boundary_km")
    return rows.select("solution_key", *[F.round(c, 6).alias(c) for c in cols])


@query("haversine", sql_with("strikes", f"""select solution_key, round({hav('lat', 'lon', '4.0::double', '102.05::double')}, 6) as km,
  round({hav('lat', 'lon', '4.0::double', '102.05::double', 6371.0)}, 6) as km_v1 from strikes"""))
def haversine(spark, sf):
    args = (F.col("lat"), F.col("lon"), F.lit(4.0), F.lit(102.05))
    return A.strikes(spark, sf).select(
        "solution_key", F.round(geo.haversine(*args), 6).alias("km"),
        F.round(geo.haversine(*args, geo.RADIUS_KM_V1), 6).alias("km_v1"),
    )


@query("source_stamp", sql_with("strikes", f"""+p as (select {split_sql('ts')} as split, '/patches/' || source_file || '/' ||
  strftime({SLOT}, '%Y%m%d_%H%M%S') || '_pos_' || solution_key || '.png' as path from strikes)
select distinct split, regexp_extract(path, '([0-9]{{8}}_[0-9]{{6}})', 1) as source_stamp from p"""))
def source_stamp(spark, sf):
    ts = F.col("ts")
    paths = A.strikes(spark, sf).select(
        timegrid.split_by_instant(ts, A.TRAIN_END, A.VAL_END).alias("split"),
        F.concat(
            F.lit("/patches/"), "source_file", F.lit("/"), F.date_format(timegrid.floor_slot(ts), "yyyyMMdd_HHmmss"),
            F.lit("_pos_"), "solution_key", F.lit(".png"),
        ).alias("path"),
    )
    return paths.select("split", F.regexp_extract("path", r"([0-9]{8}_[0-9]{6})", 1).alias("source_stamp")).distinct()


@query("metadata_features", sql_with("strikes", """select solution_key, round((lat - 3.0::double) / 3.0::double, 6) as lat_norm,
  round((lon - 102.0::double) / 2.5::double, 6) as lon_norm, round(least(greatest(amplitude / 10.0::double, -1.0::double), 1.0::double), 6) as amp_norm,
  case kind when 'Cloud' then 0 when 'Ground' then 1 else 2 end::int as kind_code,
  round((month(ts) - 6.5::double) / 5.5::double, 6) as month_norm, round((dayofyear(ts) - 183.0::double) / 182.0::double, 6) as day_norm,
  round(((month(ts) % 12) // 3) / 3.0::double, 6) as season_norm from strikes"""))
def metadata_features(spark, sf):
    features = planning.metadata_vector()
    return A.strikes(spark, sf).select(
        "solution_key", planning.kind_code(F.col("kind")).alias("kind_code"),
        *[F.round(c, 6).alias(n) for n, c in features.items()],
    )


@query("sigmoid_score", sql_with("scored", """select path, round(1 / (1 + exp(-logit)), 6) as probability,
  round(1 / (1 + exp(-logit / 1.7::double)), 6) as calibrated_probability from scored"""))
def sigmoid_score(spark, sf):
    from skyledger.functions.scores import sigmoid

    return A.predictions(spark, sf).select(
        "path", F.round(sigmoid(F.col("logit")), 6).alias("probability"),
        F.round(sigmoid(F.col("logit"), 1.7), 6).alias("calibrated_probability"),
    )


@query("decide", sql_with("predictions", """+d as (select *, (probability >= 0.5::double)::int as prediction from predictions)
select path, prediction, prediction = label as correct, case when label = 1 and prediction = 1 then 'TP'
  when label = 0 and prediction = 0 then 'TN' when label = 0 then 'FP' else 'FN' end as outcome from d"""))
def decide(spark, sf):
    from skyledger.functions.scores import decide as decision

    return decision(A.predictions(spark, sf), F.lit(0.5)).select("path", "prediction", "correct", "outcome")
