"""Selection queries: dedup, thinning, quotas, strata, ordered examples, run choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import hav, md5, query, r, rounded, rr, split_sql, sql_with, steady, u
from skyledger.catalog.clusters import STORM_LEDGER, full_ledger
from skyledger.catalog.columns import BLOCK, ground_frames
from skyledger.catalog.pairing import ledger
from skyledger.functions import scores as S
from skyledger.functions import timegrid
from skyledger.functions.hashing import hash_order, uniform
from skyledger.operators import planning, selection as P, summaries
from skyledger.operators.ranking import first_per_key, global_rank, take_per_group
from skyledger.plans.planning import Protocol, frozen_plan as build_plan, pick_active, pick_zero
from skyledger.session import cut
from skyledger.sources import adapters as A

DEDUP = """raw2 as (select solution_key, slot, ts, lat, lon from ground union all select solution_key || 'b', slot, ts, lat, lon from ground where solution_key::bigint % 5 = 0),
ded as (select * from (select *, row_number() over (partition by ts, round_even(lat, 5), round_even(lon, 5) order by ts, lat, lon, solution_key) as rn from raw2) where rn = 1)"""


def repeated(spark, sf):
    """Ground strikes with every fifth one recorded twice."""
    rows = A.ground(spark, sf).select("solution_key", "ts", "lat", "lon").withColumn(
        "frame_time", timegrid.floor_slot(F.col("ts"))
    )
    again = rows.where(F.col("solution_key").cast("bigint") % 5 == 0).withColumn(
        "solution_key", F.concat("solution_key", F.lit("b"))
    )
    return rows.unionByName(again)


@query("dedup_strikes", sql_with("ground", f"+{DEDUP} select solution_key, ts, lat, lon from ded"))
def dedup_strikes(spark, sf):
    return P.dedup_strikes(repeated(spark, sf)).select("solution_key", "ts", "lat", "lon")


def thin_sql(src: str, frame: str, name: str) -> str:
    near = hav("k.lat", "k.lon", "x[1].lat", "x[1].lon")
    return f"""{name}_l as (select {frame}, list([{{'ts': ts, 'lat': lat, 'lon': lon, 'solution_key': solution_key}}] order by ts, lat, lon, solution_key) as rows from {src} group by {frame}),
{name} as (select {frame}, list_reduce(rows, lambda acc, x: case when len(acc) >= 20 or len(list_filter(acc, lambda k: {near} < 30)) > 0 then acc else acc || x end, []) as kept from {name}_l)"""


@query("spaced_strikes", sql_with("ground", f"""+{DEDUP}, dd as (select *, slot::date::varchar as day from ded), {thin_sql('dd', 'day', 'th')}
select day, x.solution_key as solution_key from (select day, unnest(kept) as x from th)"""))
def spaced_strikes(spark, sf):
    rows = P.dedup_strikes(repeated(spark, sf)).withColumn("day", F.date_format("frame_time", "yyyy-MM-dd"))
    kept = P.spaced_strikes(rows, "day")
    return kept.select("day", F.explode("kept").alias("x")).select("day", "x.solution_key")


REMOVAL = f"""{DEDUP}, {thin_sql('ded', 'slot', 'th')},
rem as (select a.slot, a.n as candidate, a.n - b.n as deduplicated, b.n - len(th.kept) as spacing_or_cap_removed, len(th.kept) as retained
  from (select slot, count(*) as n from raw2 group by slot) a join (select slot, count(*) as n from ded group by slot) b on a.slot = b.slot join th on a.slot = th.slot)"""


@query("removal_stats", sql_with("ground", f"+{REMOVAL} select slot as frame_time, candidate, deduplicated, spacing_or_cap_removed, retained from rem"))
def removal_stats(spark, sf):
    return P.removal_stats(repeated(spark, sf), "frame_time")


@query("cap_per_frame", sql_with("ground", f"""select 'first' as rule, solution_key from (select *, row_number() over (partition by ts::date order by ts, lat, lon, solution_key) as rn from ground) where rn <= 3
union all select 'sampled', solution_key from (select *, row_number() over (partition by ts::date order by {md5('cap', 'solution_key')}) as rn from ground) where rn <= 3"""))
def cap_per_frame(spark, sf):
    rows = A.ground(spark, sf).withColumn("day", F.to_date("ts"))
    first = take_per_group(rows, ["day"], ["ts", "lat", "lon", "solution_key"], 3)
    sampled = take_per_group(rows, ["day"], [hash_order("cap", "solution_key")], 3)
    return first.select(F.lit("first").alias("rule"), "solution_key").unionByName(
        sampled.select(F.lit("sampled").alias("rule"), "solution_key")
    )


@query("head_per_day", sql_with("ground", """select slot as frame_time from (select slot, row_number() over (partition by slot::date order by slot) as rn from (select distinct slot from ground)) where rn <= 5"""))
def head_per_day(spark, sf):
    return P.head_per_day(ground_frames(spark, sf), 5)


WEIGHTS = {"train": 0.70, "val": 0.15, "test": 0.15}
TURN = """case split when 'train' then (rn - 1) / 0.70::double else (rn - 1) / 0.15::double end"""


def split_frames(spark, sf):
    return ground_frames(spark, sf).withColumn(
        "split", timegrid.split_by_instant(F.col("frame_time"), A.TRAIN_END, A.VAL_END)
    )


@query("interleave_by_split", sql_with("ground", f"""+f as (select distinct slot, {split_sql('slot')} as split from ground),
k as (select slot, split, row_number() over (partition by split order by case when split = 'train' and hour(slot) >= 12 then 0 else 1 end, slot) as rn from f)
select slot as frame_time, split, round({TURN}, 6) as turn, case split when 'train' then 0 when 'val' then 1 else 2 end::int as turn_split from k"""))
def interleave_by_split(spark, sf):
    preferred = (F.col("split") == "train") & (F.hour("frame_time") >= 12)
    return rounded_turn(P.interleave(split_frames(spark, sf), WEIGHTS, preferred))


def rounded_turn(df):
    return df.withColumn("turn", F.round("turn", 6))


@query("select_frames", sql_with("ground", f"""+f as (select distinct slot, {split_sql('slot')} as split from ground),
h as (select * from (select *, row_number() over (partition by slot::date order by slot) as rk from f) where rk <= 20),
k as (select slot, split, row_number() over (partition by split order by slot) as rn from h)
select slot as frame_time, split from (select *, {TURN} as turn from k) order by turn, case split when 'train' then 0 when 'val' then 1 else 2 end, slot limit 150"""))
def select_frames(spark, sf):
    return P.select_frames(split_frames(spark, sf), 20, 150, WEIGHTS)


STRAT = f"""st as (select slot, category, in_mask_count, {split_sql('slot')} as split, month(slot)::varchar || '|' || (((hour(slot) + 8) % 24) // 4)::varchar as stratum,
  {u('ca', "strftime(slot, '%Y%m%d_%H%M')")} < 0.3::double as cached, {md5('st', "strftime(slot, '%Y%m%d_%H%M')")} as rnd from ledger)"""


def strata(spark, sf):
    rows = planning.with_local_time(ledger(spark, sf))
    stamp = F.date_format("frame_time", "yyyyMMdd_HHmm")
    return rows.withColumns({
        "stamp": stamp, "cached": uniform("ca", stamp) < 0.3, "date": F.date_format("frame_time", "yyyy-MM-dd"),
        "split": timegrid.split_by_instant(F.col("frame_time"), A.TRAIN_END, A.VAL_END),
    })


@query("stratified_pick", sql_with("ledger", f"""+{STRAT}, k as (select *, row_number() over (partition by stratum order by (not cached)::int, rnd) as rn from st where split = 'train'),
p as (select *, row_number() over (order by (not cached)::int, rn, stratum) as pos from k where rn <= 400),
k2 as (select *, row_number() over (partition by stratum order by cached::int, rnd) as rn from st where split = 'test'),
p2 as (select *, row_number() over (order by cached::int, rn, stratum) as pos from k2)
select 'cached_first' as mode, slot as frame_time, stratum, cached from p where pos <= 400
union all select 'new_first', slot, stratum, cached from p2 where pos <= 100"""))
def stratified_pick(spark, sf):
    rows = strata(spark, sf)
    a = P.stratified_pick(rows.where("split = 'train'"), 400, "st", "stamp").withColumn("mode", F.lit("cached_first"))
    b = P.stratified_pick(rows.where("split = 'test'"), 100, "st", "stamp", prefer_cached=False).withColumn("mode", F.lit("new_first"))
    return a.unionByName(b).select("mode", "frame_time", "stratum", "cached")


PILOT = {(s, c): n for s, n in (("train", 12), ("val", 4), ("test", 4)) for c in ("active", "zero_recorded")}


@query("pilot_plan", sql_with("ledger", f"""+{STRAT}, k as (select *, case when split = 'train' then 12 else 4 end as quota,
  row_number() over (partition by split, category, stratum order by (not cached)::int, rnd) as rn from st),
p as (select *, row_number() over (partition by split, category order by (not cached)::int, rn, stratum) as pos from k)
select slot as frame_time, split, category, stratum, cached from p where pos <= quota"""))
def pilot_plan(spark, sf):
    return P.quota_plan(strata(spark, sf), PILOT, "st", "stamp").select("frame_time", "split", "category", "stratum", "cached")


QUOTAS = {"train": (468, 252), "val": (156, 84), "test": (156, 84)}


def plan_rows(spark, sf):
    """Ledger with storms, local time, cache flag and retained positives."""
    stats = P.removal_stats(A.ground(spark, sf).withColumn("frame_time", timegrid.floor_slot(F.col("ts"))), "frame_time")
    rows = planning.with_local_time(full_ledger(spark, sf))
    stamp = F.date_format("frame_time", "yyyyMMdd_HHmm")
    return rows.join(stats.select("frame_time", "retained"), "frame_time", "left").withColumns({
        "retained": F.coalesce("retained", F.lit(0)), "cached": uniform("ca", stamp) < 0.3,
        "date": F.date_format("frame_time", "yyyy-MM-dd"),
    })


PLAN = f"""{STORM_LEDGER}, {thin_sql('ground', 'slot', 'th')},
pr as (select sl.*, coalesce(len(th.kept), 0) as retained, {u('ca', "strftime(sl.slot, '%Y%m%d_%H%M')")} < 0.3::double as cached from sl left join th on sl.slot = th.slot)"""
QA = "case split when 'train' then greatest(15 * 468, 1000) else greatest(15 * 156, 1000) end"
QZ = "case split when 'train' then greatest(30 * 252, 1500) else greatest(30 * 84, 1500) end"


@query("active_candidate_pool", sql_with("ledger", f"""+{PLAN}, k as (select *, row_number() over (partition by split order by retained desc, {u('pool', 'epoch(slot)::bigint')}, slot) as rn from pr where category = 'active' and retained >= 1)
select slot as frame_time, split, retained, cached from k where rn <= {QA} or cached""", recursive=True))
def active_candidate_pool(spark, sf):
    rows = plan_rows(spark, sf).where("category = 'active' and retained >= 1")
    return P.active_pool(rows, {s: q[0] for s, q in QUOTAS.items()}, "pool").select("frame_time", "split", "retained", "cached")


@query("zero_candidate_pool", sql_with("ledger", f"""+{PLAN}, k as (select *, row_number() over (partition by split order by {u('zp', 'epoch(slot)::bigint')}, slot) as rn from pr where category <> 'active')
select slot as frame_time, split, cached from k where rn <= {QZ} or cached""", recursive=True))
def zero_candidate_pool(spark, sf):
    rows = plan_rows(spark, sf).where("category <> 'active'")
    return P.zero_pool(rows, {s: q[1] for s, q in QUOTAS.items()}, "zp").select("frame_time", "split", "cached")


PROTOCOL = Protocol(QUOTAS)


def walk_sql(name: str, pool: str, gain: str, crowd: str) -> str:
    """The plain greedy walk: every state of the pool, one pick a split and step."""
    score = f"static + ({gain}) + {crowd}"
    won = f"row_number() over (partition by split order by {score} desc, epoch) = 1"
    return f"""{name}_0 as (select *, true as new_date, true as new_storm, 0::bigint as n from {pool}),
{name}(split, slot, epoch, mix, date, storm_id, static, share, quota, new_date, new_storm, n, step, won) as (
select split, slot, epoch, mix, date, storm_id, static, share, quota, new_date, new_storm, n, 1, {won} from {name}_0
union all
select split, slot, epoch, mix, date, storm_id, static, share, quota, new_date, new_storm, n, step, {won} from (
  select split, slot, epoch, mix, date, storm_id, static, share, quota, new_date and date is distinct from w.d as new_date,
    new_storm and storm_id is distinct from w.s as new_storm, n + (mix = w.m)::int as n, step + 1 as step
  from (select *, max(case when won then struct_pack(d := date, s := storm_id, m := mix) end) over (partition by split) as w from {name})
  where not won and step < quota))"""


MIX = f"split || '|' || month(slot) || '|' || {BLOCK.format(h='((hour(slot) + 8) % 24)')}"
POOL = "slot, split, epoch(slot)::bigint as epoch, {mix} as mix, slot::date as date, storm_id, {static} as static"
TASTE = "case when cached then 10.0::double else 0.0::double end + {}"
WALKS = f"""{PLAN}, ak as (select *, {u('plana', 'epoch(slot)::bigint')} as random from pr where category = 'active' and retained >= 1),
ar as (select *, row_number() over (partition by split order by retained desc, random, slot) as rn from ak),
ap as (select {POOL.format(mix=MIX, static=f"least(retained::double, 10.0::double) * 3.0::double + ({TASTE.format('random')})")}, 0.0::double as share, case split when 'train' then 468 else 156 end as quota
  from ar where rn <= {QA} or cached),
{walk_sql('aw', 'ap', "case when new_date then 120.0::double else 0.0::double end + case when new_storm then 80.0::double else 0.0::double end", "18.0::double * (share - n / 1.0::double)")},
am as (select split, mix, count(*) / (sum(count(*)) over (partition by split))::double as share from aw where won group by split, mix),
zk as (select *, {u('planz', 'epoch(slot)::bigint')} as random from pr where category <> 'active'),
zr as (select *, row_number() over (partition by split order by random, slot) as rn from zk),
zq as (select {POOL.format(mix=MIX, static=TASTE.format('random'))} from zr where rn <= {QZ} or cached),
zp as (select zq.*, coalesce(am.share, 0.0::double) as share, case zq.split when 'train' then 252 else 84 end as quota from zq left join am on zq.split = am.split and zq.mix = am.mix),
{walk_sql('zw', 'zp', "case when new_date then 20.0::double else 0.0::double end", "100.0::double * (share - n / quota::double)")}"""


@query("select_active", sql_with("ledger", f"""+{WALKS} select aw.split, step::bigint as pick, aw.slot as frame_time, aw.storm_id, pr.retained, pr.cached
from aw join pr on aw.slot = pr.slot where won""", recursive=True))
def select_active(spark, sf):
    return pick_active(plan_rows(spark, sf), PROTOCOL).select("split", "pick", "frame_time", "storm_id", "retained", "cached")


@query("select_zero", sql_with("ledger", f"""+{WALKS} select zw.split, step::bigint as pick, zw.slot as frame_time, month(zw.slot)::int as month,
  {BLOCK.format(h='((hour(zw.slot) + 8) % 24)')} as local_time_block, pr.cached from zw join pr on zw.slot = pr.slot where won""", recursive=True))
def select_zero(spark, sf):
    rows = cut(plan_rows(spark, sf))
    out = pick_zero(rows, cut(pick_active(rows, PROTOCOL)), PROTOCOL)
    return out.select("split", "pick", "frame_time", "month", "local_time_block", "cached")


@query("frozen_plan", sql_with("ledger", f"""+{WALKS}, picked as (select slot from aw where won union all select slot from zw where won)
select pr.slot as frame_time, pr.split, category, storm_id, retained, '{PROTOCOL.digest()}' as configuration_hash, 'full' as phase,
  case when category = 'active' then 'support and diversity' else 'matched to selected active frames' end as selection_reason
from pr join picked on pr.slot = picked.slot""", recursive=True))
def frozen_plan(spark, sf):
    columns = ["frame_time", "split", "category", "storm_id", "retained", "configuration_hash", "phase", "selection_reason"]
    return build_plan(plan_rows(spark, sf), PROTOCOL).select(*columns)


SUPPORT = f"""{PLAN}, su as (select split, count(*) as frames, count(*) filter (category = 'active') as active_frames, count(*) filter (category <> 'active') as zero_recorded_frames,
  count(distinct case when category = 'active' then slot::date end) as active_dates, count(distinct case when category = 'active' then storm_id end) as storm_groups,
  sum(case when category = 'active' then retained else 0 end)::bigint as planned_positive_capacity, count(*) filter (cached) as cached_frames, count(*) filter (not cached) as download_frames from pr group by split)"""


def support(spark, sf):
    return summaries.split_support(plan_rows(spark, sf).withColumnRenamed("retained", "retained_positive_count"))


@query("split_support", sql_with("ledger", f"+{SUPPORT} select * from su", recursive=True))
def split_support(spark, sf):
    return support(spark, sf)


@query("support_blockers", sql_with("ledger", f"""+{SUPPORT}, bl as (select split, unnest([case when active_dates < 25 then 'active dates below minimum' end, case when storm_groups < 30 then 'storms below minimum' end,
  case when planned_positive_capacity < 500 then 'positive capacity below 500' end, case when active_frames < 75 then 'active frames below 75' end]) as b from su where split in ('val', 'test'))
select split, split || ' ' || b as blocker from bl where b is not null""", recursive=True))
def support_blockers(spark, sf):
    return summaries.support_blockers(support(spark, sf), 25, 30, 500, 75)


@query("balanced_sample", sql_with("manifest", f"""select path, label from manifest where label = 1
union all select path, label from (select *, row_number() over (order by {md5('bal', 'path')}, path) as rn from manifest where label = 0) where rn <= (select count(*) from manifest where label = 1)"""))
def balanced_sample(spark, sf):
    rows = A.manifest(spark, sf).select("path", "label").withColumn("_o", hash_order("bal", "path"))
    return P.balanced_sample(rows, ["_o", "path"]).select("path", "label")


@query("one_per_frame", sql_with("manifest", f"""select label, frame_id, path from (select *, row_number() over (partition by label, frame_id order by {md5('one', 'path')}, path) as rn from manifest) where rn = 1"""))
def one_per_frame(spark, sf):
    rows = A.manifest(spark, sf).select("label", "frame_id", "path", hash_order("one", "path").alias("_o"))
    return first_per_key(rows, ["label", "frame_id"], ["_o", "path"]).select("label", "frame_id", "path")


@query("evenly_spaced", sql_with("manifest", """+k as (select label, path, ts, row_number() over (partition by label order by ts, path) - 1 as i, count(*) over (partition by label) as n from manifest),
w as (select label, n, unnest(range(25)) as j from (select distinct label, n from k))
select distinct k.label, k.path, k.ts from k join w on k.label = w.label and k.i = round_even(w.j * ((k.n - 1) / 24.0::double), 0)::bigint"""))
def evenly_spaced(spark, sf):
    rows = A.manifest(spark, sf).select("label", "path", "ts")
    return P.evenly_spaced(rows, ["label"], ["ts", "path"], 25)


OUT = """oc as (select *, case when label = 1 and probability >= 0.5::double then 'TP' when label = 0 and probability < 0.5::double then 'TN' when label = 0 then 'FP' else 'FN' end as outcome from predictions where split = 'test')"""


def outcomes(spark, sf):
    rows = A.predictions(spark, sf).where("split = 'test'").select("path", "label", "frame_id", "probability")
    return S.decide(rows, F.lit(0.5))


@query("distinct_frame_examples", sql_with("predictions", f"""+{OUT}, o as (select *, {md5('ex', 'path')} as h from oc),
tp as (select * from (select *, row_number() over (partition by frame_id order by h, path) as rn from o where outcome = 'TP') where rn = 1 order by h, path limit 4),
tn as (select * from (select *, row_number() over (partition by frame_id order by h, path) as rn from o where outcome = 'TN' and frame_id not in (select frame_id from tp)) where rn = 1 order by h, path limit 4)
select frame_id, path, outcome from tp union all select frame_id, path, outcome from tn"""))
def distinct_frame_examples(spark, sf):
    return P.distinct_frame_examples(outcomes(spark, sf), "ex", "path").select("frame_id", "path", "outcome")


@query("outcome_examples", sql_with("predictions", f"+{OUT} select outcome, min(path) as path from oc group by outcome"))
def outcome_examples(spark, sf):
    return outcomes(spark, sf).groupBy("outcome").agg(F.min("path").alias("path"))


def epochs(spark, sf):
    return global_rank(A.history(spark, sf), ["run_id"], ["step"], "epoch")


@query("best_epoch", sql_with("history", """select run_id, arg_min(epoch, (loss, epoch)) as by_loss, arg_max(epoch, (pr_auc, -loss, -epoch)) as by_pr_auc from history group by run_id"""))
def best_epoch(spark, sf):
    e = F.col("epoch")
    return epochs(spark, sf).groupBy("run_id").agg(
        F.min_by(e, F.struct("loss", "epoch")).alias("by_loss"),
        F.max_by(e, F.struct(F.col("pr_auc"), (-F.col("loss")).alias("l"), (-e).alias("e"))).alias("by_pr_auc"),
    )


@query("early_stop_epoch", sql_with("history", """+a as (select *, row(pr_auc, -loss) as q from history),
b as (select *, max(q) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding) as prior from a),
c as (select *, case when prior is null or q > prior then epoch end as imp from b),
d as (select *, max(imp) over (partition by run_id order by epoch) as last from c),
s as (select run_id, min(case when epoch - last >= 3 then epoch end) as stop_epoch, max(epoch) as final from d group by run_id)
select d.run_id, max(imp) as best_epoch, coalesce(any_value(s.stop_epoch), 0) as stop_epoch from d join s on d.run_id = s.run_id where epoch <= coalesce(stop_epoch, final) group by d.run_id"""))
def early_stop_epoch(spark, sf):
    # 0 stands for a run that never stopped early
    return P.early_stop(epochs(spark, sf), "run_id", "epoch", 3).fillna(0, ["stop_epoch"])




@query("select_primary_runs", sql_with("runs", """+ru as (select *, architecture || '_' || (run_id % 50)::varchar as arch from runs),
g as (select arch, loss_name, augmentation, count(*) as n, avg(validation_pr_auc) as pr, avg(validation_loss) as ls from ru group by all having count(*) = 3),
b as (select *, row_number() over (partition by arch order by round(pr, 9) desc, round(ls, 9), loss_name desc, augmentation desc) as rn from g)
select ru.run_id, ru.arch as architecture, ru.loss_name, ru.augmentation from ru join b on ru.arch = b.arch and ru.loss_name = b.loss_name and ru.augmentation = b.augmentation and b.rn = 1"""))
def select_primary_runs(spark, sf):
    rows = A.runs(spark, sf).withColumn(
        "architecture", F.concat_ws("_", "architecture", (F.col("run_id") % 50).cast("string"))
    )
    return P.primary_runs(rows, 3).select("run_id", "architecture", "loss_name", "augmentation")


@query("seed_summary", sql_with("runs", f"""select architecture, count(*) as runs, {rr('avg(validation_pr_auc)')} as pr_auc_mean, {rr('stddev_pop(validation_pr_auc)')} as pr_auc_std, min(validation_pr_auc) as pr_auc_min, max(validation_pr_auc) as pr_auc_max,
  {rr('avg(validation_roc_auc)')} as roc_auc_mean, {rr('stddev_pop(validation_roc_auc)')} as roc_auc_std, min(validation_roc_auc) as roc_auc_min, max(validation_roc_auc) as roc_auc_max from runs group by architecture"""))
def seed_summary(spark, sf):
    cols = []
    for m in ("pr_auc", "roc_auc"):
        v = F.col(f"validation_{m}")
        cols += [steady(F.avg(v)).alias(f"{m}_mean"), steady(F.stddev_pop(v)).alias(f"{m}_std"), F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max")]
    return A.runs(spark, sf).groupBy("architecture").agg(F.count(F.lit(1)).alias("runs"), *cols)


@query("leaderboard", sql_with("runs", """+x as (select 'neural_' || architecture || '_' || run_id::varchar as model, 'neural' as source, validation_pr_auc as pr_auc, validation_roc_auc as roc_auc from runs where run_id % 3 = 0
union all select case when run_id % 2 = 0 then 'b13_min_' else 'mean_channel_' end || run_id::varchar, 'baseline', validation_pr_auc, null from runs where run_id % 3 = 1
union all select 'latlon_' || run_id::varchar, 'baseline', validation_pr_auc, null from runs where run_id % 3 = 2),
f as (select *, case when source = 'neural' then 'neural' when model like 'b13_min%' or model like 'mean_channel%' then 'simple_image' when model like '%latlon%' then 'geographic' else 'other' end as family from x)
select family, model, source, pr_auc, roc_auc from (select *, row_number() over (partition by family order by pr_auc desc, model) as rn from f) where rn = 1"""))
def leaderboard(spark, sf):
    return board(spark, sf)


def board(spark, sf):
    from skyledger.operators.gates import best_per_family

    rows = A.runs(spark, sf)
    k = F.col("run_id")
    score = [F.col("validation_pr_auc").alias("pr_auc"), F.col("validation_roc_auc").alias("roc_auc")]
    neural = rows.where(k % 3 == 0).select(
        F.concat_ws("_", F.lit("neural"), "architecture", k.cast("string")).alias("model"), F.lit("neural").alias("source"), *score
    )
    image = rows.where(k % 3 == 1).select(
        F.concat(F.when(k % 2 == 0, "b13_min_").otherwise("mean_channel_"), k.cast("string")).alias("model"), F.lit("baseline").alias("source"), score[0]
    )
    place = rows.where(k % 3 == 2).select(F.concat(F.lit("latlon_"), k.cast("string")).alias("model"), F.lit("baseline").alias("source"), score[0])
    return best_per_family(neural.unionByName(image, allowMissingColumns=True).unionByName(place, allowMissingColumns=True))
