"""Join queries: frames, patch centres, calendars, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import hav, query, rr, sql_with, steady, u
from skyledger.catalog.columns import OBJECTS, ground_frames
from skyledger.functions import geo, timegrid
from skyledger.functions.hashing import uniform
from skyledger.operators import joins, planning
from skyledger.operators.ranking import global_rank
from skyledger.sources import adapters as A


@query("bin_calendar", sql_with("strikes calendar ground", """select c.slot as frame_time, c.slot::date::varchar as date, g.slot is not null as recorded_ground_event,
  case when g.slot is not null then 'active' else 'zero_recorded' end as category
  from calendar c left join (select distinct slot from ground) g on c.slot = g.slot"""))
def bin_calendar(spark, sf):
    return planning.bin_calendar(A.strikes(spark, sf))


def ledger(spark, sf):
    return planning.candidate_ledger(
        planning.bin_calendar(A.strikes(spark, sf)),
        planning.bin_summary(A.ground(spark, sf).where(geo.MASK.contains(F.col("lat"), F.col("lon")))),
    )


@query("candidate_ledger", sql_with("ledger", """select slot as frame_time, slot::date::varchar as date, in_mask_count > 0 as recorded_ground_event, in_mask_count,
  category, round(clat, 6) as centroid_lat, round(clon, 6) as centroid_lon from ledger"""))
def candidate_ledger(spark, sf):
    return ledger(spark, sf).withColumns({c: F.round(c, 6) for c in ("centroid_lat", "centroid_lon")})


@query("frame_strikes", sql_with("ground", """+f as (select distinct slot as t from ground)
select t as frame_time, solution_key from f join ground on slot = t"""))
def frame_strikes(spark, sf):
    slotted = A.ground(spark, sf).withColumn("frame_time", timegrid.floor_slot(F.col("ts")))
    frames = slotted.select("frame_time").distinct()
    return frames.join(slotted, "frame_time").select("frame_time", "solution_key")


@query("window_strikes", sql_with("ground", """+f as (select distinct slot as t from ground)
select t as frame_time, (select count(*) from ground g where g.ts >= t and g.ts < t + interval '10 minutes') as same_slot_count,
  (select count(*) from ground g where g.ts > t and g.ts <= t + interval '60 minutes') as nowcast_count from f"""))
def window_strikes(spark, sf):
    strikes, frames = A.ground(spark, sf), ground_frames(spark, sf)
    same = joins.window_counts(frames, strikes, 0, 10).withColumnRenamed("strike_count", "same_slot_count")
    return joins.window_counts(same, strikes, 0, 60, left_open=True).withColumnRenamed("strike_count", "nowcast_count")


@query("query_window", sql_with("ground", """+f as (select distinct slot as t from ground)
select t as frame_time, solution_key from f join ground g on g.ts >= t - interval '20 minutes' and g.ts < t + interval '30 minutes'"""))
def query_window(spark, sf):
    pairs = joins.window_join(ground_frames(spark, sf), A.ground(spark, sf), -20, 30)
    return pairs.select("frame_time", "solution_key")


BOX = """abs(g.lat - c.lat) <= 0.64::double + {m}::double / 111.32::double
  and abs(g.lon - c.lon) <= 0.64::double + {m}::double / (111.32::double * greatest(cos(radians(c.lat)), 0.1::double))"""


@query("patch_clear", sql_with("candidates ground", f"""select c.candidate_id, count(g.ts) = 0 as clear, count(g.ts) as inside_count
  from candidates c left join ground g on g.ts >= c.frame_time - interval '20 minutes' and g.ts < c.frame_time + interval '30 minutes'
  and {BOX.format(m='10.0')} group by c.candidate_id"""))
def patch_clear(spark, sf):
    rows = joins.patch_clear(A.candidates(spark, sf), A.ground(spark, sf), -20, 30, 10.0)
    return rows.select("candidate_id", "clear", "inside_count")


@query("nearest_strike", sql_with("candidates ground", f"""+p as (select c.candidate_id, c.frame_time, g.ts, g.lat, g.lon, {hav('g.lat', 'g.lon', 'c.lat', 'c.lon')} as km
  from candidates c join ground g on g.ts >= c.frame_time - interval '20 minutes' and g.ts < c.frame_time + interval '30 minutes'),
b as (select *, row_number() over (partition by candidate_id order by km, ts, lat, lon) as rn from p)
select c.candidate_id, {rr('b.km')} as nearest_distance_km, {rr('(epoch_us(b.ts) - epoch_us(c.frame_time)) / 60000000.0::double')} as nearest_minutes
  from candidates c left join b on c.candidate_id = b.candidate_id and b.rn = 1"""))
def nearest_strike(spark, sf):
    rows = joins.nearest_strike(A.candidates(spark, sf), A.ground(spark, sf), -20, 30)
    return rows.select(
        "candidate_id", steady("nearest_distance_km").alias("nearest_distance_km"),
        steady("nearest_minutes").alias("nearest_minutes"),
    )


@query("min_distance_filter", sql_with("candidates ground", f"""select c.candidate_id from candidates c where not exists (select 1 from ground g
  where g.slot = c.frame_time and {hav('g.lat', 'g.lon', 'c.lat', 'c.lon', 6371.0)} < 30)"""))
def min_distance_filter(spark, sf):
    return joins.min_distance_filter(A.candidates(spark, sf), A.ground(spark, sf), 0, 10, 30.0).select("candidate_id")


WINDOWS = [("same_frame", 0, 10, 10.0), ("plus_minus_10", -10, 20, 10.0), ("primary", -20, 30, 10.0), ("plus_minus_30", -30, 40, 10.0)]


@query("contamination_audit", sql_with("candidates ground", f"""+w as (select * from (values ('same_frame', 0, 10), ('plus_minus_10', -10, 20), ('primary', -20, 30), ('plus_minus_30', -30, 40)) v(wname, a, b)),
h as (select c.candidate_id, w.wname, count(g.ts) as k from candidates c cross join w left join ground g
  on g.ts >= c.frame_time + to_minutes(w.a) and g.ts < c.frame_time + to_minutes(w.b) and {BOX.format(m='10.0')} group by all)
select wname as "window", count(*) as negatives, count(*) filter (k > 0) as contaminated from h group by wname"""))
def contamination_audit(spark, sf):
    return joins.contamination_audit(A.candidates(spark, sf), A.ground(spark, sf), WINDOWS)


OCC = """occ as (select time_bucket(interval '1 hour', ts) as time_bin,
  least(greatest(floor((lat - 1.2::double) / 0.5::double), 0), 10)::int as lat_idx,
  least(greatest(floor((lon - 99.7::double) / 0.5::double), 0), 8)::int as lon_idx, count(*) as strike_count from strikes group by all)"""


@query("free_cells", sql_with("strikes", f"""+{OCC}
select b.time_bin, i.i::int as lat_idx, j.j::int as lon_idx from (select distinct time_bin from occ) b cross join range(11) i(i) cross join range(9) j(j)
  where not exists (select 1 from occ o where o.time_bin = b.time_bin and o.lat_idx = i.i and o.lon_idx = j.j)"""))
def free_cells(spark, sf):
    from skyledger.plans.occurrence import occurrence_cells

    return joins.free_cells(occurrence_cells(A.strikes(spark, sf)), 11, 9)


@query("no_event_days", sql_with("strikes", """select d::date::varchar as date from generate_series(timestamp '2023-12-01', timestamp '2024-03-31', interval '1 day') t(d)
  where d::date not in (select ts::date from strikes)"""))
def no_event_days(spark, sf):
    return joins.no_event_days(A.strikes(spark, sf), "2023-12-01", "2024-03-31")


@query("label_exists", sql_with("strikes", """+p as (select vec_id, (vec_id % 97) / 10.0::double as lat from embeddings),
e as (select distinct lat from strikes where kind = 'Ground')
select vec_id as patch_id, (exists (select 1 from e where abs(e.lat - p.lat) < 0.5::double))::int as label from p"""))
def label_exists(spark, sf):
    patches = A.patches(spark, sf).select("patch_id", ((F.col("patch_id") % 97) / 10.0).alias("lat"))
    return joins.label_exists(patches, A.ground(spark, sf)).select("patch_id", "label")


def cached_frames(spark, sf):
    frames = ground_frames(spark, sf)
    listing = planning.frame_objects(frames).where(uniform("a", "object_key") < 0.8).select("object_key")
    return planning.cache_complete(frames, listing)


@query("cache_complete", sql_with("ground", f"""+{OBJECTS}
select t as frame_time, bool_and({u('a', 'object_key')} < 0.8::double) as cached,
  count(*) filter ({u('a', 'object_key')} >= 0.8::double) as missing_objects from objects group by t"""))
def cache_complete(spark, sf):
    return cached_frames(spark, sf)


PLANNED = f"""planned as (select distinct 'H09_' || strftime(slot, '%Y%m%d_%H%M') as frame_id, slot as window_start, slot + interval '10 minutes' as window_end,
  case when slot <= timestamp '2024-01-21 23:59:59' then 'train' when slot <= timestamp '2024-01-25 23:59:59' then 'val' else 'test' end as split from ground),
done as (select p.frame_id, case when {u('d1', 'p.frame_id')} < 0.1::double then 'test' else p.split end as split,
  case when {u('d2', 'p.frame_id')} < 0.1::double then 'B13' else 'B08+B13+B15' end as bands, '05+06' as segments, p.window_start,
  case when {u('d3', 'p.frame_id')} < 0.1::double then p.window_start else p.window_end end as window_end,
  case when {u('d4', 'p.frame_id', 'k')} < 0.02::double then '' else 'p/' || p.frame_id || '_' || k end as path
  from planned p cross join range(3) r(k) where {u('d0', 'p.frame_id')} < 0.7::double)"""


def planned_and_done(spark, sf):
    """Planned frames, and rows of an earlier build that is wrong here and there."""
    t = F.col("frame_time")
    planned = ground_frames(spark, sf).select(
        timegrid.frame_id(t).alias("frame_id"), t.alias("window_start"), timegrid.plus_minutes(t, 10).alias("window_end"),
        timegrid.split_by_instant(t, A.TRAIN_END, A.VAL_END).alias("split"),
    )
    done = planned.where(uniform("d0", "frame_id") < 0.7).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        "frame_id", F.when(uniform("d1", "frame_id") < 0.1, "test").otherwise(F.col("split")).alias("split"),
        F.when(uniform("d2", "frame_id") < 0.1, "B13").otherwise("B08+B13+B15").alias("bands"), F.lit("05+06").alias("segments"),
        "window_start",
        F.when(uniform("d3", "frame_id") < 0.1, F.col("window_start")).otherwise(F.col("window_end")).alias("window_end"),
        F.when(uniform("d4", "frame_id", "k") < 0.02, "").otherwise(F.concat_ws("_", F.concat(F.lit("p/"), "frame_id"), F.col("k").cast("string"))).alias("path"),
    )
    return planned, done


@query("pending_frames", sql_with("ground", f"""+{PLANNED},
ok as (select d.frame_id from done d join planned p on d.frame_id = p.frame_id group by d.frame_id
  having bool_and(d.split = p.split and d.bands = 'B08+B13+B15' and d.segments = '05+06' and d.window_start = p.window_start and d.window_end = p.window_end and d.path <> ''))
select frame_id, split from planned where frame_id not in (select frame_id from ok)"""))
def pending_frames(spark, sf):
    planned, done = planned_and_done(spark, sf)
    return planning.pending_frames(planned, done, "B08+B13+B15", "05+06").select("frame_id", "split")


@query("resumed_manifest", sql_with("ground", f"""+{PLANNED},
ok as (select d.frame_id from done d join planned p on d.frame_id = p.frame_id group by d.frame_id
  having bool_and(d.split = p.split and d.bands = 'B08+B13+B15' and d.segments = '05+06' and d.window_start = p.window_start and d.window_end = p.window_end and d.path <> ''))
select d.frame_id, d.split, d.path, true as kept from done d join ok on d.frame_id = ok.frame_id
union all select frame_id, split, 'again/' || frame_id, false from planned where frame_id not in (select frame_id from ok)"""))
def resumed_manifest(spark, sf):
    planned, done = planned_and_done(spark, sf)
    redone = planned.withColumns({
        "bands": F.lit("B08+B13+B15"), "segments": F.lit("05+06"), "path": F.concat(F.lit("again/"), "frame_id"),
    })
    out = planning.resumed_manifest(planned, done, redone, "B08+B13+B15", "05+06")
    return out.select("frame_id", "split", "path", "kept")


@query("target_assignment", sql_with("calendar ground", f"""+z as (select slot, case when slot <= timestamp '2024-01-21 23:59:59' then 'train' when slot <= timestamp '2024-01-25 23:59:59' then 'val' else 'test' end as split
  from calendar where slot not in (select slot from ground)),
n as (select z.slot, z.split, k.k, row_number() over (partition by split order by slot, k.k) - 1 as i from z cross join range(2) k(k)),
t as (select solution_key, split, row_number() over (partition by split order by ts, lat, lon, solution_key) - 1 as j, count(*) over (partition by split) as m
  from (select *, case when ts <= timestamp '2024-01-21 23:59:59' then 'train' when ts <= timestamp '2024-01-25 23:59:59' then 'val' else 'test' end as split from ground))
select n.slot as frame_time, n.split, n.k::int as number, t.solution_key as target from n join t on n.split = t.split and n.i % t.m = t.j"""))
def target_assignment(spark, sf):
    rows = ledger(spark, sf).where(F.col("category") == "zero_recorded")
    split = timegrid.split_by_instant
    zero = rows.select("frame_time", split(F.col("frame_time"), A.TRAIN_END, A.VAL_END).alias("split"))
    targets = A.ground(spark, sf).select(
        "ts", "lat", "lon", F.col("solution_key").alias("target"), split(F.col("ts"), A.TRAIN_END, A.VAL_END).alias("split")
    )
    from skyledger.plans.labels import assign_targets

    return assign_targets(zero, targets, 2).select("frame_time", "split", "number", "target")


@query("prediction_alignment", sql_with("predictions", f"""+m as (select path, row_number() over (order by path) as position from predictions where split = 'test'),
p as (select path, case when {u('al', 'path')} < 0.01::double then position + 1 else position end as position from m where {u('ms', 'path')} >= 0.02::double
  union all select path, position from m where {u('du', 'path')} < 0.03::double
  union all select path || 'x', 0 from m where {u('ex', 'path')} < 0.01::double),
pg as (select path, count(*) as n, min(position) as at from p group by path), mg as (select path, count(*) as n, min(position) as at from m group by path)
select count(*) filter (pg.n is null) as missing, count(*) filter (mg.n is null) as extra, sum(greatest(coalesce(pg.n, 1) - 1, 0))::bigint as duplicate_predictions,
  sum(greatest(coalesce(mg.n, 1) - 1, 0))::bigint as duplicate_manifest, count(*) filter (pg.at <> mg.at) as out_of_place from pg full join mg on pg.path = mg.path"""))
def prediction_alignment(spark, sf):
    m = global_rank(A.predictions(spark, sf).where("split = 'test'").select("path"), [], ["path"], "position")
    at = F.col("position")
    p = (
        m.where(uniform("ms", "path") >= 0.02)
        .select("path", F.when(uniform("al", "path") < 0.01, at + 1).otherwise(at).alias("position"))
        .unionByName(m.where(uniform("du", "path") < 0.03))
        .unionByName(m.where(uniform("ex", "path") < 0.01).select(F.concat("path", F.lit("x")).alias("path"), F.lit(0).cast("bigint").alias("position")))
    )
    return joins.prediction_alignment(p, m)
