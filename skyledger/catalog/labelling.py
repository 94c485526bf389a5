"""Sampling and labelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import hav, query, rr, split_sql, sql_with, steady, u
from skyledger.catalog.columns import BLOCK
from skyledger.catalog.pairing import BOX, OCC, ledger
from skyledger.catalog.picks import thin_sql
from skyledger.functions import timegrid
from skyledger.functions.hashing import uniform
from skyledger.operators import joins, planning, selection, summaries
from skyledger.plans import labels as L
from skyledger.plans import occurrence as O
from skyledger.session import cut
from skyledger.sources import adapters as A

NEG = f"""free as (select b.time_bin, i.i::int as lat_idx, j.j::int as lon_idx from (select distinct time_bin from occ) b cross join range(11) i(i) cross join range(9) j(j)
  where not exists (select 1 from occ o where o.time_bin = b.time_bin and o.lat_idx = i.i and o.lon_idx = j.j)),
q as (select time_bin, 3 * count(*) as quota from occ group by time_bin),
neg as (select time_bin, lat_idx, lon_idx from (select f.*, q.quota, row_number() over (partition by f.time_bin order by md5(concat_ws('|', 'neg', epoch(f.time_bin)::bigint, lat_idx, lon_idx)), lat_idx, lon_idx) as rn
  from free f join q on f.time_bin = q.time_bin) where rn <= quota)"""


@query("occurrence_cells", sql_with("strikes", f"+{OCC} select time_bin, lat_idx, lon_idx, strike_count, 1 as label from occ"))
def occurrence_cells(spark, sf):
    return O.occurrence_cells(A.strikes(spark, sf))


@query("occurrence_negatives", sql_with("strikes", f"+{OCC}, {NEG} select time_bin, lat_idx, lon_idx, 0::bigint as strike_count, 0 as label from neg"))
def occurrence_negatives(spark, sf):
    return O.occurrence_negatives(O.occurrence_cells(A.strikes(spark, sf)))


OCC_ALL = f"""{OCC}, {NEG}, al as (select time_bin, lat_idx, lon_idx, strike_count, 1 as label from occ union all select time_bin, lat_idx, lon_idx, 0, 0 from neg),
tb as (select time_bin, row_number() over (order by time_bin) - 1 as i, count(*) over () as n from (select distinct time_bin from al)),
ct as (select min(case when i = floor(0.70::double * n) then time_bin end) as t1, min(case when i = floor(0.85::double * n) then time_bin end) as t2 from tb),
od as (select al.*, round(1.2::double + (lat_idx + 0.5::double) * 0.5::double, 6) as latitude, round(99.7::double + (lon_idx + 0.5::double) * 0.5::double, 6) as longitude,
  month(time_bin)::int as month, hour(time_bin)::int as hour, dayofyear(time_bin)::int as day_of_year, ((month(time_bin) % 12) // 3)::int as season,
  case when time_bin < t1 then 'train' when time_bin < t2 then 'val' else 'test' end as split from al, ct)"""


@query("occurrence_dataset", sql_with("strikes", f"+{OCC_ALL} select time_bin, split, latitude, longitude, month, hour, day_of_year, season, strike_count, label from od"))
def occurrence_dataset(spark, sf):
    rows = O.occurrence_dataset(A.strikes(spark, sf))
    return rows.select(
        "time_bin", "split", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"),
        "month", "hour", "day_of_year", "season", "strike_count", "label",
    )


@query("occurrence_stats", sql_with("strikes", f"""+{OCC_ALL} select count(*) as rows, count(*) filter (label = 1) as positive, count(*) filter (label = 0) as negative,
  {rr("(count(*) filter (label = 0))::double / greatest(count(*) filter (label = 1), 1)")} as neg_pos_ratio, count(*) filter (split = 'train') as train_rows, count(*) filter (split = 'val') as val_rows,
  count(*) filter (split = 'test') as test_rows, (select count(*) from strikes) as source_rows from od"""))
def occurrence_stats(spark, sf):
    strikes = A.strikes(spark, sf)
    stats = summaries.occurrence_stats(O.occurrence_dataset(strikes), strikes.count())
    return stats.withColumn("neg_pos_ratio", steady("neg_pos_ratio"))


DAYS = """days as (select d::date as date, row_number() over (order by d) as dn, count(*) over () as nd from generate_series(timestamp '2023-01-01', timestamp '2026-03-31', interval '1 day') t(d) where d::date not in (select ts::date from strikes))"""


def norm(seed: str) -> str:
    return f"sqrt(ln(greatest({u(seed + 'a', 'i')}, 1e-12::double)) * -2) * cos({u(seed + 'b', 'i')} * (2.0::double * pi()))"


META = f"""{DAYS}, mo as (select count(*) as n, avg(lat) as lat, avg(lon) as lon, greatest(stddev_pop(lat), 0.5) as lat_sd, greatest(stddev_pop(lon), 0.5) as lon_sd,
  greatest(stddev_pop(amplitude) / 3.0, 1.5) as amp_sd, avg((kind = 'Cloud')::int::double) as cloud_share from strikes),
ng as (select date, k.k * nd + dn - 1 as i from days cross join range(10) k(k), mo where k.k * nd + dn - 1 < least(3 * mo.n, 10 * nd)),
mn as (select i, 0 as label, date, {norm('la')} * lat_sd + lat as lat, {norm('lo')} * lon_sd + lon as lon, least(greatest({norm('am')} * amp_sd, -20.0::double), 20.0::double) as amplitude,
  case when {u('kd', 'i')} < cloud_share then 'Cloud' else 'Ground' end as kind from ng, mo)"""


def quiet_days(spark, sf):
    return joins.no_event_days(A.strikes(spark, sf), "2023-01-01", "2026-03-31")


ROUND = ("lat", "lon", "amplitude")


@query("metadata_negatives", sql_with("strikes", f"+{META} select i, label, date::varchar as date, {', '.join(f'{rr(c)} as {c}' for c in ROUND)}, kind from mn"))
def metadata_negatives(spark, sf):
    rows = L.metadata_negatives(A.strikes(spark, sf), quiet_days(spark, sf))
    return rows.withColumns({c: steady(c) for c in ROUND})


@query("metadata_dataset", sql_with("strikes", f"""+{META}, al as (select 'p' || solution_key as key, 1 as label, ts::date as date, lat, lon, amplitude, kind from strikes
union all select 'n' || i::varchar, label, date, lat, lon, amplitude, kind from mn),
rk as (select *, row_number() over (order by md5(concat_ws('|', 'meta', key)), key) as position, count(*) over () as n from al)
select key, label, date::varchar as date, {', '.join(f'{rr(c)} as {c}' for c in ROUND)}, kind, position, case when position <= floor(0.7::double * n) then 'train'
  when position <= floor(0.85::double * n) then 'val' else 'test' end as split from rk"""))
def metadata_dataset(spark, sf):
    rows = L.metadata_dataset(A.strikes(spark, sf), quiet_days(spark, sf))
    return rows.withColumns({c: steady(c) for c in ROUND})


# an image is 8 x 8 blocks on 235 x 280 pixels; its dark blocks as rectangles of pixels
FRAMES = f"""im as (select row_number() over (order by vec_id) - 1 as k, count(*) over () as n, not (label = 9 and vec_id % 2 = 1) as readable,
  list_transform(list_filter(generate_series(0, 63), lambda i: 255.0::double + 60.0::double * embedding[i + 1]::double < 240.0::double),
    lambda i: {{'x0': ((i % 8) * 235 + 7) // 8, 'x1': ((i % 8 + 1) * 235 + 7) // 8, 'y0': (i // 8) * 35, 'y1': (i // 8) * 35 + 35}}) as dark from embeddings),
fr as (select slot as t, category, {split_sql('slot')} as split, readable, dark from ledger join im on (epoch(slot) / 600)::bigint % n = k)"""


def frames(spark, sf):
    """All ledger frames with the black areas of their images; frames take the images in turn."""
    images = cut(A.images(spark, sf))
    t = F.col("frame_time")
    rows = ledger(spark, sf).select(
        "frame_time", "category", timegrid.split_by_instant(t, A.TRAIN_END, A.VAL_END).alias("split"),
        F.pmod(timegrid.slot_number(t), F.lit(images.count())).alias("image_id"),
    )
    return L.with_images(rows, images, A.black_pixels(images))


CLEAR = """not exists (select 1 from ground g where g.ts >= {c}.t - interval '20 minutes' and g.ts < {c}.t + interval '30 minutes'
  and abs(g.lat - {c}.lat) <= 0.64::double + 10.0::double / 111.32::double and abs(g.lon - {c}.lon) <= 0.64::double + 10.0::double / (111.32::double * greatest(cos(radians({c}.lat)), 0.1::double)))"""


# pixels that the crop around (x, y) shares with the dark rectangles
COVER = ("coalesce(list_sum(list_transform(dark, lambda q: greatest(least(x + 32, q.x1) - greatest(x - 32, q.x0), 0) * greatest(least(y + 32, q.y1) - greatest(y - 32, q.y0), 0))), 0)"
         " / 4096.0::double <= 0.02::double")


def draws_sql(name: str, frames: str, low: int, high: int) -> str:
    """CTE ``name(t, attempt, x, y)``: usable attempts ``low..high`` of the readable frames."""
    return f"""{name}_dr as (select t, dark, attempt::int as attempt, floor({u('rnx', 'epoch(t)::bigint', 'attempt')} * 171)::int + 32 as x, floor({u('rny', 'epoch(t)::bigint', 'attempt')} * 216)::int + 32 as y
  from {frames} cross join range({low}, {high + 1}) a(attempt) where readable),
{name}_pl as (select *, 6.8::double - y / 279.0::double * (6.8::double - 1.2::double) as lat, 99.7::double + x / 234.0::double * (104.4::double - 99.7::double) as lon from {name}_dr
  where {COVER}),
{name} as (select pl.t, attempt, x, y from {name}_pl pl left join ground g on g.slot = pl.t group by pl.t, attempt, x, y having min({hav('g.lat', 'g.lon', 'pl.lat', 'pl.lon', 6371.0)}) >= 30 or count(g.ts) = 0)"""


# all ten thousand attempts count; the later ones are only drawn for frames that still lack centres
@query("random_negatives", sql_with("ledger", f"""+{FRAMES}, act as (select * from fr where category = 'active'), {draws_sql('ok1', 'act', 1, 1000)},
short as (select * from act where t not in (select t from ok1 group by t having count(*) >= 3)), {draws_sql('ok2', 'short', 1001, 10000)}
select t as frame_time, attempt, x, y from (select *, row_number() over (partition by t order by attempt) as rn from (select * from ok1 union all select * from ok2)) where rn <= 3"""))
def random_negatives(spark, sf):
    active = frames(spark, sf).where("category = 'active'")
    return L.random_negatives(active, A.ground(spark, sf), 3, 10_000).select("frame_time", "attempt", "x", "y")


PIX = "round_even(({o} - 99.7::double) / (104.4::double - 99.7::double) * 234, 0)::int as x, round_even((6.8::double - {a}) / (6.8::double - 1.2::double) * 279, 0)::int as y"
POSITIVES = f"""{thin_sql('ground', 'slot', 'th')},
re as (select slot as t, generate_subscripts(kept, 1) - 1 as number, unnest(kept) as p from th),
rp as (select re.t, number, p.ts as ts, p.lat as lat, p.lon as lon, p.solution_key as solution_key, fr.split, fr.category, fr.dark, fr.readable from re join fr on re.t = fr.t),
ps as (select * from (select *, {PIX.format(o='lon', a='lat')} from rp) where x - 32 >= 0 and y - 32 >= 0 and x + 32 <= 235 and y + 32 <= 280 and readable and {COVER})"""


def match_sql(targets: str) -> str:
    """CTE ``mt``: picks for ``targets(t, number, t_lat, t_lon, dark, pos)`` where ``pos`` is 'x_y' or null."""
    key = ("epoch(t)::bigint", "number", "level", "draw")
    used = "list_filter(acc[1].used || [s[1].pos], lambda z: z is not null)"
    pick = f"list_filter(s[1].opts, lambda o: not list_contains({used}, o.xy))[1]"
    return f"""of as (select * from (values (0, 0, 0), (1, -1, 0), (2, 1, 0), (3, 0, -1), (4, 0, 1), (5, -1, -1), (6, 1, 1), (7, -1, 1), (8, 1, -1)) v(level, dy, dx)),
c0 as (select tg.*, level, 1.2::double + (floor((t_lat - 1.2::double) / 0.5::double) + dy) * 0.5::double as lat0, 99.7::double + (floor((t_lon - 99.7::double) / 0.5::double) + dx) * 0.5::double as lon0 from {targets} tg cross join of),
c1 as (select *, greatest(lat0, 1.2::double) as la, least(lat0 + 0.5::double, 6.8::double) as lb, greatest(lon0, 99.7::double) as oa, least(lon0 + 0.5::double, 104.4::double) as ob from c0),
c2 as (select t, number, t_lat, t_lon, level, draw::int as draw, la + (lb - la) * {u('mla', *key)} as lat, oa + (ob - oa) * {u('mlo', *key)} as lon from c1 cross join range(1, 201) d(draw) where la < lb and oa < ob),
cp as materialized (select * from (select *, {PIX.format(o='lon', a='lat')} from c2) where x >= 32 and y >= 32 and x < 203 and y < 248),
c3 as (select * from cp where t in (select t from fr where len(dark) = 0) union all select * exclude (dark) from (select cp.*, dark from cp join fr on cp.t = fr.t where len(dark) > 0) where {COVER}),
c4 as (select distinct c3.t, c3.number, c3.level, c3.draw from c3 join ground g on g.slot >= c3.t - interval '20 minutes' and g.slot < c3.t + interval '30 minutes' and g.slot in (c3.t - interval '20 minutes', c3.t - interval '10 minutes', c3.t, c3.t + interval '10 minutes', c3.t + interval '20 minutes')
  where abs(g.lat - c3.lat) <= 0.64::double + 10.0::double / 111.32::double and abs(g.lon - c3.lon) <= 0.64::double + 10.0::double / (111.32::double * greatest(cos(radians(c3.lat)), 0.1::double))),
c5 as (select * from c3 anti join c4 using (t, number, level, draw)),
c6 as (select t, number, list({{'level': level, 'draw': draw, 'lat': lat, 'lon': lon, 'x': x, 'y': y, 'xy': x::varchar || '_' || y::varchar}} order by level, draw) as opts from c5 group by t, number),
c7 as (select tg.t, list([{{'number': tg.number::bigint, 'pos': tg.pos, 'opts': c6.opts}}] order by tg.number) as steps from {targets} tg left join c6 on tg.t = c6.t and tg.number = c6.number group by tg.t),
c8 as (select t, number, o from (select t, unnest(pk) as z from (select t, list_reduce(list_transform(steps, lambda e: [{{'used': []::varchar[], 'picks': [{{'number': e[1].number, 'o': e[1].opts[1]}}][1:0], 's': e}}]),
  lambda acc, w: [{{'used': case when list_filter(w[1].s[1].opts, lambda o: not list_contains(acc[1].used || [coalesce(w[1].s[1].pos, '')], o.xy))[1] is null then acc[1].used || [coalesce(w[1].s[1].pos, '')]
      else acc[1].used || [coalesce(w[1].s[1].pos, '')] || [list_filter(w[1].s[1].opts, lambda o: not list_contains(acc[1].used || [coalesce(w[1].s[1].pos, '')], o.xy))[1].xy] end,
    'picks': acc[1].picks || [{{'number': w[1].s[1].number, 'o': list_filter(w[1].s[1].opts, lambda o: not list_contains(acc[1].used || [coalesce(w[1].s[1].pos, '')], o.xy))[1]}}], 's': w[1].s}}],
  [{{'used': []::varchar[], 'picks': [{{'number': steps[1][1].number, 'o': steps[1][1].opts[1]}}][1:0], 's': steps[1]}}])[1].picks as pk from c7)) q, lateral (select z.number as number, z.o as o)),
mt as (select c8.t, c8.number, o.level as level, o.draw as draw, o.lat as lat, o.lon as lon, o.x as x, o.y as y from c8 where o is not null)"""


@query("matched_negatives", sql_with("ledger", f"""+{FRAMES}, {POSITIVES},
tg as (select t, number, lat as t_lat, lon as t_lon, dark, x::varchar || '_' || y::varchar as pos from ps), {match_sql('tg')}
select t as frame_time, number::int as number, level::int as level, draw, {rr('lat')} as lat, {rr('lon')} as lon, x, y from mt"""))
def matched_negatives(spark, sf):
    strikes = A.ground(spark, sf)
    retained = selection.retained_strikes(strikes.withColumn("frame_time", timegrid.floor_slot(F.col("ts"))), "frame_time")
    positives = L.positive_patches(retained, frames(spark, sf))
    picks = L.matched_negatives(L.active_targets(positives), strikes)
    return picks.select("frame_time", "number", "level", "draw", steady("lat").alias("lat"), steady("lon").alias("lon"), "x", "y")


CONTROLLED = f"""{FRAMES}, {POSITIVES},
zs as (select t, split, dark, readable, k.k as number, row_number() over (partition by split order by t, k.k) - 1 as i from fr cross join range(2) k(k) where category <> 'active'),
rg as (select *, row_number() over (partition by split order by ts, lat, lon, solution_key) - 1 as j, count(*) over (partition by split) as m from rp),
tg as (select t, number, lat as t_lat, lon as t_lon, dark, x::varchar || '_' || y::varchar as pos from ps
  union all select zs.t, zs.number, rg.lat, rg.lon, zs.dark, null from zs join rg on zs.split = rg.split and zs.i % rg.m = rg.j where zs.readable), {match_sql('tg')},
cm as (select t, number, 1 as label, lat, lon, x, y, null as match_level from ps union all select t, number, 0, lat, lon, x, y, case when level = 0 then 'same_grid_cell' else 'neighbour_grid_cell' end from mt),
cf as (select cm.*, fr.split, fr.category from cm join fr on cm.t = fr.t)"""


@query("controlled_manifest", sql_with("ledger", f"""+{CONTROLLED}
select t as frame_time, number::int as number, label, split, category, {rr('lat')} as lat, {rr('lon')} as lon, x, y, match_level,
  floor((lat - 1.2::double) / 0.5::double)::bigint::varchar || '_' || floor((lon - 99.7::double) / 0.5::double)::bigint::varchar as grid_cell,
  {rr('least(lat - 1.2::double, 6.8::double - lat, lon - 99.7::double, 104.4::double - lon) * 111.0::double')} as distance_to_boundary_km from cf"""))
def controlled_manifest(spark, sf):
    rows = L.controlled_manifest(frames(spark, sf), A.ground(spark, sf))
    return rows.select(
        "frame_time", "number", "label", "split", "category", steady("lat").alias("lat"), steady("lon").alias("lon"), "x", "y",
        "match_level", "grid_cell", steady("distance_to_boundary_km").alias("distance_to_boundary_km"),
    )


GRID = f"""{FRAMES}, gd as (select t, dark, readable, x.x::int as x, y.y::int as y, 6.8::double - y.y / 279.0::double * (6.8::double - 1.2::double) as lat, 99.7::double + x.x / 234.0::double * (104.4::double - 99.7::double) as lon
  from fr cross join range(32, 204, 64) x(x) cross join range(32, 249, 64) y(y) where split = 'test')"""


def test_frames(spark, sf):
    return frames(spark, sf).where("split = 'test'")


@query("natural_grid", sql_with("ledger", f"+{GRID} select t as frame_time, x, y, {rr('lat')} as lat, {rr('lon')} as lon from gd"))
def natural_grid(spark, sf):
    return L.natural_grid(test_frames(spark, sf)).select(
        "frame_time", "x", "y", steady("lat").alias("lat"), steady("lon").alias("lon")
    )


NATURAL = f"""{GRID}, gv as materialized (select * exclude (dark) from gd where readable and {COVER}),
gc as (select gv.*, (select count(*) from ground g where g.slot = gv.t and abs(g.lat - gv.lat) <= 0.64::double and abs(g.lon - gv.lon) <= 0.64::double) as hits,
  (select count(*) from ground g where g.ts >= gv.t - interval '20 minutes' and g.ts < gv.t + interval '30 minutes' and abs(g.lat - gv.lat) <= 0.64::double + 10.0::double / 111.32::double
    and abs(g.lon - gv.lon) <= 0.64::double + 10.0::double / (111.32::double * greatest(cos(radians(gv.lat)), 0.1::double))) as near from gv),
nl as (select *, case when hits > 0 then 'positive' when near > 0 then 'ambiguous' else 'negative' end as outcome from gc union all by name select t, -1 as x, -1 as y, 0::bigint as hits, 0::bigint as near, 'failed' as outcome from fr where split = 'test' and not readable)"""


@query("natural_labels", sql_with("ledger", f"+{NATURAL} select t as frame_time, x, y, hits, near, outcome from nl"))
def natural_labels(spark, sf):
    return L.natural_labels(test_frames(spark, sf), A.ground(spark, sf))


@query("natural_summary", sql_with("ledger", f"""+{NATURAL} select count(*) filter (outcome in ('positive', 'negative')) as eligible, count(*) filter (outcome = 'positive') as positive, count(*) filter (outcome = 'negative') as negative,
  {rr("(count(*) filter (outcome = 'positive'))::double / count(*) filter (outcome in ('positive', 'negative'))")} as prevalence, count(*) filter (outcome = 'ambiguous') as ambiguous_excluded, count(*) filter (outcome = 'failed') as failed from nl"""))
def natural_summary(spark, sf):
    labelled = L.natural_labels(test_frames(spark, sf), A.ground(spark, sf))
    return summaries.natural_summary(labelled).withColumn("prevalence", steady("prevalence"))


@query("prevalence_breakdown", sql_with("ledger", f"""+{NATURAL}, el as (select nl.*, (outcome = 'positive')::int as label, fr.category, month(nl.t)::varchar as month, (hour(nl.t) + 8) % 24 as h from nl join fr on nl.t = fr.t where outcome in ('positive', 'negative')),
lg as (select 'category' as dimension, category as value, label from el union all select 'local_time_block', {BLOCK.format(h='h')}, label from el union all select 'month', month, label from el)
select dimension, value, count(*) as samples, sum(label)::bigint as positive, (count(*) - sum(label))::bigint as negative, {rr('sum(label)::double / count(*)')} as prevalence from lg group by all"""))
def prevalence_breakdown(spark, sf):
    test = test_frames(spark, sf)
    rows = L.natural_labels(test, A.ground(spark, sf)).where("outcome in ('positive', 'negative')")
    rows = planning.with_local_time(rows.join(test.select("frame_time", "category"), "frame_time")).withColumn(
        "label", (F.col("outcome") == "positive").cast("int")
    )
    out = summaries.prevalence_breakdown(rows, ["category", "local_time_block", "month"])
    return out.withColumn("prevalence", steady("prevalence"))


@query("reconcile_splits", sql_with("manifest", f"""+rc as (select label, split, {split_sql('frame_time')} as new_split from manifest)
select new_split, count(*) as rows, count(*) filter (split <> new_split) as corrected from rc group by new_split"""))
def reconcile_splits(spark, sf):
    rows = planning.reconcile_splits(
        A.manifest(spark, sf), timegrid.split_by_instant(F.col("frame_time"), A.TRAIN_END, A.VAL_END)
    )
    return rows.groupBy("new_split").agg(F.count(F.lit(1)).alias("rows"), F.count_if("changed").alias("corrected"))
