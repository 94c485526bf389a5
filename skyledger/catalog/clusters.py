"""Component queries: storms and within-frame clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import hav, query, split_sql, sql_with
from skyledger.catalog.pairing import ledger
from skyledger.functions import timegrid
from skyledger.operators import components
from skyledger.sources import adapters as A

STORMS = """act as (select slot, (epoch(slot) / 600)::bigint as id, epoch(slot) / 60.0::double / 60.0::double as t,
  clon * 111.32::double * cos(radians((select avg(clat) from ledger where category = 'active'))) / 75.0::double as x, clat * 111.32::double / 75.0::double as y
  from ledger where category = 'active'),
edges as (select a.id as a, b.id as b from act a join act b on b.id between a.id - 6 and a.id + 6 and a.id <> b.id
  and sqrt((a.t - b.t) * (a.t - b.t) + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.0::double),
reach(a, b) as (select id, id from act union select r.a, e.b from reach r join edges e on r.b = e.a),
comp as (select a as id, min(b) as root from reach group by a),
storm as (select act.slot, 'DERIVED_STORM_' || printf('%06d', dense_rank() over (order by root) - 1) as storm_id from act join comp on act.id = comp.id)"""


@query("storm_groups", sql_with("ledger", f"+{STORMS} select slot as frame_time, storm_id from storm", recursive=True))
def storm_groups(spark, sf):
    active = ledger(spark, sf).where("category = 'active'")
    return components.storm_groups(active).select("frame_time", "storm_id")


STORM_LEDGER = f"""{STORMS}, latest as (select storm_id, max(slot) as last from storm group by storm_id),
sl as (select l.slot, l.category, l.in_mask_count, coalesce(s.storm_id, 'ZERO_RECORDED_' || strftime(l.slot, '%Y%m%d_%H%M')) as storm_id,
  {split_sql('coalesce(t.last, l.slot)')} as split from ledger l left join storm s on l.slot = s.slot left join latest t on s.storm_id = t.storm_id)"""


@query("storm_ledger", sql_with("ledger", f"+{STORM_LEDGER} select slot as frame_time, category, in_mask_count, storm_id, split from sl", recursive=True))
def storm_ledger(spark, sf):
    return full_ledger(spark, sf).select("frame_time", "category", "in_mask_count", "storm_id", "split")


def full_ledger(spark, sf):
    return components.storm_ledger(ledger(spark, sf), A.TRAIN_END, A.VAL_END)


CLUSTERS = f"""pt as (select distinct ts::date as d, lat, lon from ground), pn as (select *, row_number() over (order by d, lat, lon) as id from pt),
edges as (select a.id as a, b.id as b from pn a join pn b on a.d = b.d and a.id <> b.id and {hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371.0)} <= 20),
reach(a, b) as (select id, id from pn union select r.a, e.b from reach r join edges e on r.b = e.a),
comp as (select a as id, min(b) as root from reach group by a),
cl as (select distinct d, root from pn join comp on pn.id = comp.id),
sp as (select case when d <= date '2024-01-21' then 'train' when d <= date '2024-01-25' then 'val' else 'test' end as split from cl),
fc as (select coalesce(split, 'all') as split, count(*) as clusters from sp group by grouping sets ((split), ()))"""


@query("frame_clusters", sql_with("ground", f"+{CLUSTERS} select * from fc", recursive=True))
def frame_clusters(spark, sf):
    points = A.ground(spark, sf).withColumn("day", F.to_date("ts"))
    labels = components.frame_clusters(points, "day").select("frame", "component").distinct()
    split = timegrid.split_by_date(F.col("frame").cast("timestamp"), "2024-01-21", "2024-01-25")
    return labels.withColumn("split", split).rollup("split").agg(F.count(F.lit(1)).alias("clusters")).withColumn(
        "split", F.coalesce("split", F.lit("all"))
    )


@query("group_disjoint_split", sql_with("ledger", f"+{STORM_LEDGER} select storm_id, min(split) as split, count(*) as frames from sl where category = 'active' group by storm_id", recursive=True))
def group_disjoint_split(spark, sf):
    from skyledger.operators import planning

    storms = components.storm_groups(ledger(spark, sf).where("category = 'active'")).select("frame_time", "storm_id")
    out = planning.group_disjoint_split(storms, "storm_id", "frame_time", A.TRAIN_END, A.VAL_END)
    return out.groupBy("storm_id").agg(F.min("split").alias("split"), F.count(F.lit(1)).alias("frames"))
