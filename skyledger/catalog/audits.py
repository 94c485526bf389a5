"""Summary, drift, validator, gate and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import hav, query, rounded, rr, split_sql, sql_with, steady, u
from skyledger.catalog.clusters import STORM_LEDGER, full_ledger
from skyledger.catalog.pairing import BOX
from skyledger.catalog.picks import board
from skyledger.catalog.rasters import AUDIT, patch_audit
from skyledger.catalog.verify import FULL
from skyledger.functions import geo, timegrid
from skyledger.functions.hashing import uniform
from skyledger.operators import drift, gates, joins, metrics, planning, summaries
from skyledger.operators.ranking import first_per_key
from skyledger.session import cut
from skyledger.sources import adapters as A
from skyledger.sources import files


@query("bin_summary", sql_with("summary", f"select slot as frame_time, n as strike_count, {rr('clat')} as centroid_lat, {rr('clon')} as centroid_lon from summary"))
def bin_summary(spark, sf):
    return rounded(planning.bin_summary(A.ground(spark, sf)), ["centroid_lat", "centroid_lon"])


@query("class_by_split", sql_with("manifest", "select split, label, count(*) as rows, count(distinct case when label = 1 then frame_id end) as positive_frames from manifest group by split, label"))
def class_by_split(spark, sf):
    return summaries.class_by_split(A.manifest(spark, sf))


@query("build_metrics", sql_with("manifest", f"""+pl as (select distinct frame_id from manifest), bt as (select distinct frame_id from manifest where {u('un', 'frame_id')} >= 0.03::double)
select (select count(*) from pl) as frames_planned, (select count(*) from bt) as frames_built, (select count(*) from pl) - (select count(*) from bt) as unavailable_frames,
  (select count(*) from manifest where frame_id in (select frame_id from bt)) as patches, (select sum((x1 - x0) * (y1 - y0) * 3)::bigint from manifest where frame_id in (select frame_id from bt)) as patch_bytes"""))
def build_metrics(spark, sf):
    rows = A.manifest(spark, sf)
    built = uniform("un", "frame_id") >= 0.03
    frames = rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum(
        (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * 3
    ).alias("b")).withColumn("built", built)
    return frames.agg(
        F.count(F.lit(1)).alias("frames_planned"), F.count_if("built").alias("frames_built"),
        F.count_if(~F.col("built")).alias("unavailable_frames"), F.sum(F.when(F.col("built"), F.col("n"))).alias("patches"),
        F.sum(F.when(F.col("built"), F.col("b"))).alias("patch_bytes"),
    )


def share(unit: str, name: str) -> str:
    return f"{name}_ as (select split, max(n)::double / sum(n) as largest_{name}_fraction from (select split, {unit}, count(*) as n from manifest group by all) group by split)"


DOMINANCE = f"""{share('frame_id', 'frame')}, {share('date', 'date')}, {share('storm_id', 'storm')},
pf as (select split, quantile_cont(n, 0.5) as positive_per_frame_median, max(n) as positive_per_frame_max from (select split, frame_id, count(*) as n from manifest where label = 1 group by all) group by split),
dm as (select split, count(*) as patches, count(*) filter (label = 1) as positive, count(*) filter (label = 0) as negative, count(distinct date) as dates, count(distinct frame_id) as frames,
  count(distinct case when label = 1 then frame_id end) as positive_frames, count(distinct storm_id) as storms, count(distinct case when label = 1 then date end) as active_dates from manifest group by split),
dom as (select * from dm join pf using (split) join frame_ using (split) join date_ using (split) join storm_ using (split))"""
SHARES = ["largest_frame_fraction", "largest_date_fraction", "largest_storm_fraction"]


@query("cluster_dominance", sql_with("manifest", f"""+{DOMINANCE} select * replace ({', '.join(f'{rr(c)} as {c}' for c in SHARES)}) from dom"""))
def cluster_dominance(spark, sf):
    return rounded(summaries.cluster_dominance(A.manifest(spark, sf)), SHARES)


DIST = """count(*) as count, quantile_cont(n, 0.5) as median, quantile_cont(n, 0.25) as q1, quantile_cont(n, 0.75) as q3, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) as iqr, max(n) as maximum"""


@query("distribution_summary", sql_with("manifest", f"select split, {DIST}, {rr('avg(n)')} as mean from (select split, frame_id, count(*) as n from manifest group by all) group by split"))
def distribution_summary(spark, sf):
    sizes = summaries.group_sizes(A.manifest(spark, sf), ["split"], "frame_id")
    return rounded(summaries.size_distribution(sizes, ["split"]), ["mean"])


def per_frame(prefix: str, where: str) -> str:
    return f"""{prefix}_d as (select scope, quantile_cont(n, 0.5) as {prefix}_per_frame_median, quantile_cont(n, 0.25) as {prefix}_per_frame_q1, quantile_cont(n, 0.75) as {prefix}_per_frame_q3,
  quantile_cont(n, 0.75) - quantile_cont(n, 0.25) as {prefix}_per_frame_iqr, max(n) as {prefix}_per_frame_maximum, {rr('avg(n)')} as {prefix}_per_frame_mean from (select scope, frame_id, count(*) as n from bo where {where} group by all) group by scope)"""


POSITIVE_CLUSTERS = f"""pp as (select distinct split, frame_id, lat, lon from manifest where label = 1), pn as (select *, row_number() over (order by split, frame_id, lat, lon) as id from pp),
edges as (select a.id as a, b.id as b from pn a join pn b on a.split = b.split and a.frame_id = b.frame_id and a.id <> b.id and {hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371.0)} <= 20),
reach(a, b) as (select id, id from pn union select r.a, e.b from reach r join edges e on r.b = e.a),
comp as (select a as id, min(b) as root from reach group by a),
fc as (select coalesce(split, 'all') as split, count(*) as clusters from (select distinct split, root from pn join comp on pn.id = comp.id) group by grouping sets ((split), ()))"""


@query("independence_report", sql_with("manifest", f"""+{POSITIVE_CLUSTERS}, bo as (select *, 'all' as scope from manifest union all select *, split from manifest), {per_frame('patches', 'true')}, {per_frame('positives', 'label = 1')},
ba as (select scope, count(*) as patches, count(*) filter (label = 1) as positive_patches, count(distinct frame_id) as frames, count(distinct date) as dates, count(distinct case when label = 1 then frame_id end) as positive_frames from bo group by scope)
select ba.*, patches_d.* exclude (scope), positives_d.* exclude (scope), fc.clusters from ba join patches_d using (scope) left join positives_d using (scope) left join fc on fc.split = ba.scope""", recursive=True))
def independence_report(spark, sf):
    rows = A.manifest(spark, sf)
    out = summaries.independence_report(rows, summaries.positive_clusters(rows))
    return rounded(out, ["patches_per_frame_mean", "positives_per_frame_mean"])


@query("coordinate_quantiles", sql_with("manifest", f"""+lg as (select label, 'lat' as coordinate, lat as v from manifest union all select label, 'lon', lon from manifest)
select label, coordinate, count(*) as n, {', '.join(f'{rr(f"quantile_cont(v, {q})")} as {n}' for n, q in (('minimum', '0.0'), ('q1', '0.25'), ('median', '0.5'), ('q3', '0.75'), ('maximum', '1.0')))} from lg group by all"""))
def coordinate_quantiles(spark, sf):
    out = summaries.coordinate_quantiles(A.manifest(spark, sf), ["label"], ["lat", "lon"])
    return rounded(out, ["minimum", "q1", "median", "q3", "maximum"])


@query("value_distribution", sql_with("manifest", """+lg as (select 'split' as "column", split as "value" from manifest union all select 'category', case when local_hour > 3 then frame_category end from manifest union all select 'label', label::varchar from manifest)
select "column", coalesce("value", '<null>') as "value", count(*) as rows from lg group by all"""))
def value_distribution(spark, sf):
    rows = A.manifest(spark, sf).withColumn("category", F.when(F.col("local_hour") > 3, F.col("frame_category")))
    out = summaries.value_distribution(rows, ["split", "category", "label"])
    return out.withColumn("value", F.coalesce("value", F.lit("<null>")))


@query("download_accounting", """with l as (select case when o_orderkey % 3 = 0 then 'direct' else 'prefetch' end as source, case when o_orderstatus = 'P' then 'failed' else 'completed' end as status,
  (o_custkey % 7)::bigint as new_files, floor(o_totalprice)::bigint as new_bytes from orders)
select source, status, count(*) as frames, sum(new_files)::bigint as files, sum(new_bytes)::bigint as bytes from l group by all
union all select 'all', 'all', count(*), sum(new_files)::bigint, sum(new_bytes)::bigint from l""")
def download_accounting(spark, sf):
    rows = A.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, "direct").otherwise("prefetch").alias("source"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"),
        (F.col("o_custkey") % 7).alias("new_files"), F.floor("o_totalprice").alias("new_bytes"),
    )
    parts = summaries.download_accounting(rows)
    total = parts.agg(
        F.lit("all").alias("source"), F.lit("all").alias("status"), F.sum("frames").alias("frames"),
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"),
    )
    return parts.unionByName(total)


@query("split_date_ranges", sql_with("manifest", "select split, min(ts) as first_ts, max(ts) as last_ts, count(*) as rows from manifest group by split"))
def split_date_ranges(spark, sf):
    return A.manifest(spark, sf).groupBy("split").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("rows")
    )


@query("probability_summary", sql_with("predictions", f"""select run_name, label, count(*) as n, {rr('quantile_cont(probability, 0.25)')} as q1, {rr('quantile_cont(probability, 0.5)')} as median, {rr('quantile_cont(probability, 0.75)')} as q3,
  {rr('avg(case when label = 1 then (probability > 0.9::double)::int else (probability < 0.1::double)::int end)')} as confident_share from predictions where split = 'test' group by all"""))
def probability_summary(spark, sf):
    out = summaries.probability_summary(A.predictions(spark, sf).where("split = 'test'"), ["run_name"])
    return rounded(out, ["q1", "median", "q3", "confident_share"])


@query("probability_histogram", sql_with("predictions", """+b as (select run_name, label, len(list_filter(generate_series(1, 29), lambda i: i * (1.0::double / 30) <= probability)) as bin, count(*) as n from predictions group by all)
select r.run_name, l.label::int as label, i.i::int as bin, coalesce(b.n, 0) as n from (select distinct run_name from predictions) r cross join (select unnest([0, 1]) as label) l cross join range(30) i(i)
  left join b on b.run_name = r.run_name and b.label = l.label and b.bin = i.i"""))
def probability_histogram(spark, sf):
    return summaries.probability_histogram(A.predictions(spark, sf), ["run_name"])


FEATURES = ["lat", "lon", "local_hour", "month", "boundary_km"]


def feat(keys: str, names, src: str = "manifest") -> str:
    head = f"{keys}, " if keys else ""
    return " union all ".join(f"select {head}label, '{f}' as feature, {f}::double as v from {src}" for f in names)


def hist_sql(keys: str, names, bins: int, src: str = "manifest") -> str:
    head = f"{keys}, " if keys else ""
    on = " and ".join(f"b.{c} = e.{c}" for c in [*keys.split(", "), "feature"] if c)
    return f"""ft as ({feat(keys, names, src)}),
ex as (select {head}feature, min(v) as lo, max(v) as hi from ft group by all),
hb as (select {head}feature, least(greatest(floor((v - lo) / ((hi + 1e-9::double - lo) / {bins})), 0), {bins - 1})::int as bin, sum(label) as pos, count(*) - sum(label) as neg from ft join ex using ({head}feature) group by all),
hi as (select {', '.join(f'e.{c}' for c in [*keys.split(', '), 'feature'] if c)}, i.i::int as bin, coalesce(b.pos, 0)::bigint as pos, coalesce(b.neg, 0)::bigint as neg from ex e cross join range({bins}) i(i) left join hb b on {on} and b.bin = i.i)"""


@query("score_histogram_by_label", sql_with("manifest", f"""+{hist_sql('', FEATURES[:4], 12)}, sm as (select feature, sum(pos) as ap, sum(neg) as an from hi group by feature)
select feature, bin, {rr('pos / greatest(ap, 1)')} as positive_share, {rr('neg / greatest(an, 1)')} as negative_share from hi join sm using (feature)"""))
def score_histogram_by_label(spark, sf):
    hist = summaries.feature_histogram(A.manifest(spark, sf), [], FEATURES[:4], 12)
    sums = hist.groupBy("feature").agg(F.sum("pos").alias("ap"), F.sum("neg").alias("an"))
    return hist.join(sums, "feature").select(
        "feature", "bin", steady(F.col("pos") / F.greatest("ap", F.lit(1))).alias("positive_share"),
        steady(F.col("neg") / F.greatest("an", F.lit(1))).alias("negative_share"),
    )


@query("grid_label_crosstab", sql_with("manifest", "select grid_cell, count(*) filter (label = 0) as negatives, count(*) filter (label = 1) as positives from manifest group by grid_cell"))
def grid_label_crosstab(spark, sf):
    return summaries.grid_label_crosstab(A.manifest(spark, sf))


def drift_sql(keys: str, src: str = "manifest") -> str:
    head = f"{keys}, " if keys else ""
    group = f"{head}feature"
    return f"""{hist_sql(keys, FEATURES, 10, src)},
mm as (select {group}, avg(v) filter (label = 1) as positive_mean, avg(v) filter (label = 0) as negative_mean, sqrt((var_samp(v) filter (label = 1) + var_samp(v) filter (label = 0)) / 2) as pooled from ft group by all),
su as (select {group}, sum(pos) as ap, sum(neg) as an from hi group by all),
pq as (select {group}, (pos + 1e-6::double) / (ap + 1e-5::double) as p, (neg + 1e-6::double) / (an + 1e-5::double) as q from hi join su using ({group})),
dv as (select {group}, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 as js, sum((p - q) * ln(p / q)) as psi from pq group by all),
kc as (select {group}, v, sum(sum(label)) over (partition by {group} order by v) as cp, sum(count(*) - sum(label)) over (partition by {group} order by v) as cn from ft group by {group}, v),
ks as (select {group}, max(abs(cp / ap - cn / an)) as ks_statistic, max(ap)::bigint as n_pos, max(an)::bigint as n_neg from kc join su using ({group}) group by all),
dr as (select {group}, positive_mean, negative_mean, coalesce((positive_mean - negative_mean) / nullif(pooled, 0), 0) as standardized_mean_difference, js as jensen_shannon_divergence, psi as population_stability_index, ks_statistic, n_pos, n_neg
  from mm join dv using ({group}) join ks using ({group}))"""


DRIFT = ["positive_mean", "negative_mean", "standardized_mean_difference", "jensen_shannon_divergence", "population_stability_index", "ks_statistic"]
DR = ", ".join(f"{rr(c)} as {c}" for c in DRIFT)


@query("balance_drift", sql_with("manifest", f"+{drift_sql('')} select feature, {DR}, n_pos, n_neg from dr"))
def balance_drift(spark, sf):
    return rounded(drift.balance_drift(A.manifest(spark, sf), [], FEATURES), DRIFT)


@query("ks_pvalue", sql_with("manifest", f"""+{drift_sql('')}, z as (select feature, ks_statistic, sqrt(n_pos::double * n_neg / (n_pos + n_neg)) * ks_statistic as s from dr)
select feature, {rr('ks_statistic')} as ks_statistic, {rr("case when s < 0.04 then 1 else least(greatest(list_sum(list_transform(generate_series(1, 100), lambda k: (case when k % 2 = 1 then 2.0::double else -2.0::double end) * exp(-2.0::double * k * k * s * s))), 0), 1) end")} as ks_pvalue from z"""))
def ks_pvalue(spark, sf):
    ks = drift.ks_statistic(A.manifest(spark, sf), [], FEATURES)
    tested = ks.withColumn("ks_pvalue", drift.ks_pvalue(F.col("ks_statistic"), F.col("n_pos"), F.col("n_neg")))
    return rounded(tested.select("feature", "ks_statistic", "ks_pvalue"), ["ks_statistic", "ks_pvalue"])


@query("grid_js", sql_with("manifest", f"""+g as (select grid_cell, count(*) filter (label = 1) + 1e-6::double as p, count(*) filter (label = 0) + 1e-6::double as q from manifest group by grid_cell),
n as (select p / (select sum(p) from g) as p, q / (select sum(q) from g) as q from g)
select {rr('sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2')} as jensen_shannon_divergence, (select count(*) from g where p > 0.5) as occupied_cells_positive, (select count(*) from g where q > 0.5) as occupied_cells_negative from n"""))
def grid_js(spark, sf):
    return rounded(drift.grid_js(A.manifest(spark, sf)), ["jensen_shannon_divergence"])


@query("drift_by_split", sql_with("manifest", f"""+mz as (select 'current' as version, * from manifest union all select 'older', * from manifest where {u('old', 'path')} < 0.5::double), {drift_sql('version, split', 'mz')}
select version, split, feature, {DR}, n_pos, n_neg from dr"""))
def drift_by_split(spark, sf):
    rows = A.manifest(spark, sf)
    both = rows.withColumn("version", F.lit("current")).unionByName(
        rows.where(uniform("old", "path") < 0.5).withColumn("version", F.lit("older"))
    )
    return rounded(drift.balance_drift(both, ["version", "split"], FEATURES), DRIFT)


REQUIRED = ["path", "label", "split", "ts", "frame_id", "lat", "lon", "window_start"]
CHECKS = f"""ck as (select 'split_mismatch' as c, path as e, 1 as n from manifest where split <> {split_sql('frame_time')}
union all select 'image_after_strike', path, 1 from manifest where frame_time > ts
union all select 'duplicate_path', path, count(*) - 1 from manifest group by path having count(*) > 1
union all select 'frame_in_several_splits', frame_id, 1 from manifest group by frame_id having count(distinct split) > 1
union all select 'date_in_several_splits', date, 1 from manifest group by date having count(distinct split) > 1),
cs as (select n.c as "check", coalesce((select sum(ck.n) from ck where ck.c = n.c), 0)::bigint as violations,
  coalesce((select string_agg(e, ',' order by e) from (select e from ck where ck.c = n.c order by e limit 3)), '') as examples
  from (select unnest(['split_mismatch', 'image_after_strike', 'duplicate_path', 'frame_in_several_splits', 'date_in_several_splits']) as c) n
  union all select 'missing_columns', 1, 'window_start')"""


@query("manifest_checks", sql_with("manifest", f"+{CHECKS} select * from cs"))
def manifest_checks(spark, sf):
    expected = timegrid.split_by_instant(F.col("frame_time"), A.TRAIN_END, A.VAL_END)
    return gates.manifest_checks(A.manifest(spark, sf), expected, REQUIRED)


CROP = "frame_id || '|' || x0 || '|' || y0 || '|' || x1 || '|' || y1"
OVERLAP = f"""kv as (select split, 'date' as kind, date as value from manifest union all select split, 'frame_id', frame_id from manifest union all select split, 'storm_id', storm_id from manifest
union all select split, 'path', path from manifest union all select split, 'sha256', sha256 from manifest union all select split, 'crop', {CROP} from manifest
union all select split, 'source_file', unnest(string_split(source_files, ';')) from manifest),
sd as (select kind, value, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from kv group by all),
ov as (select kind, count(*) filter (train > 0 and val > 0) as train_val, count(*) filter (train > 0 and test > 0) as train_test, count(*) filter (val > 0 and test > 0) as val_test,
  sum(greatest(train - 1, 0) + greatest(val - 1, 0) + greatest(test - 1, 0))::bigint as within_split_repeats from sd group by kind)"""


def overlap(spark, sf):
    crop = F.concat_ws("|", "frame_id", *[F.col(c).cast("string") for c in ("x0", "y0", "x1", "y1")])
    keys = {k: F.col(k) for k in ("date", "frame_id", "storm_id", "path", "sha256")}
    return gates.split_overlap(
        A.manifest(spark, sf), {**keys, "crop": crop}, {"source_file": F.split("source_files", ";")}
    )


@query("split_overlap", sql_with("manifest", f"+{OVERLAP} select * from ov"))
def split_overlap(spark, sf):
    return overlap(spark, sf)


@query("mask_violations", sql_with("manifest", """select split, count(*) filter (not (lat between 1.5::double and 6.5::double and lon between 100.0::double and 104.1::double)) as centres_outside,
  count(*) filter (not (x0 >= 0 and y0 >= 0 and x1 <= 235 and y1 <= 280)) as crops_outside from manifest group by split"""))
def mask_violations(spark, sf):
    mask = geo.Mask(1.5, 6.5, 100.0, 104.1)
    bounds = F.struct("x0", "y0", "x1", "y1")
    return A.manifest(spark, sf).groupBy("split").agg(
        F.count_if(~mask.contains(F.col("lat"), F.col("lon"))).alias("centres_outside"),
        F.count_if(~geo.crop_inside(bounds)).alias("crops_outside"),
    )


@query("plan_checks", sql_with("ledger", f"""+{STORM_LEDGER}
select 'repeated_frames' as "check", (count(*) - count(distinct slot))::bigint as violations from sl
union all select 'dates_in_several_splits', count(*) from (select slot::date from sl group by slot::date having count(distinct split) > 1)
union all select 'storms_in_several_splits', count(*) from (select storm_id from sl group by storm_id having count(distinct split) > 1)
union all select 'objects_in_several_splits', 0""", recursive=True))
def plan_checks(spark, sf):
    plan = full_ledger(spark, sf).select("frame_time", "storm_id", "split")
    objects = planning.frame_objects(plan).select(F.col("object_key").alias("value"), "split")

    def several(df, name):
        return df.groupBy("value").agg(F.countDistinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("violations")).select(
            F.lit(name).alias("check"), "violations"
        )

    repeated = plan.groupBy("frame_time").agg((F.count(F.lit(1)) - 1).alias("r")).agg(F.sum("r").alias("violations"))
    out = repeated.select(F.lit("repeated_frames").alias("check"), "violations")
    out = out.unionByName(several(plan.select(F.to_date("frame_time").alias("value"), "split"), "dates_in_several_splits"))
    out = out.unionByName(several(plan.select(F.col("storm_id").alias("value"), "split"), "storms_in_several_splits"))
    return out.unionByName(several(objects, "objects_in_several_splits"))


@query("crop_uniqueness", sql_with("manifest", """select 'frame_id' as scope, frame_id as "group", x0, y0, count(*) as copies, count(distinct label) as labels from manifest group by all having count(*) > 1
union all select 'date', date, x0, y0, count(*), count(distinct label) from manifest group by all having count(*) > 1"""))
def crop_uniqueness(spark, sf):
    rows = A.manifest(spark, sf)
    return gates.crop_repeats(rows, "frame_id").unionByName(gates.crop_repeats(rows, "date"))


@query("determinism_check", sql_with("manifest", """select count(*) as rows, true as "match", false as altered_match from manifest"""))
def determinism_check(spark, sf):
    cols = ["path", "label", "split", "frame_id", "x", "y", "sha256"]
    first = files.fingerprint(A.manifest(spark, sf).select(*cols))
    again = files.fingerprint(A.manifest(spark, sf).repartition(7, "path").select(*cols))
    altered = files.fingerprint(A.manifest(spark, sf).select(*cols).withColumn("x", F.col("x") + (F.col("path") == "p1").cast("int")))
    tagged = first.withColumn("t", F.lit(1)).unionByName(again.withColumn("t", F.lit(2))).unionByName(altered.withColumn("t", F.lit(3)))

    def mark(i):
        return F.max(F.when(F.col("t") == i, F.struct("rows", "hash_a", "hash_b")))

    return tagged.agg(
        F.max("rows").alias("rows"), (mark(1) == mark(2)).alias("match"), (mark(1) == mark(3)).alias("altered_match")
    )


@query("score_sanity", sql_with("scored", """select run_name, count(*) as rows, count(*) filter (probability < 0 or probability > 1 or probability is null) as out_of_range,
  count(*) filter (abs(1 / (1 + exp(-logit)) - probability) > 1e-6) as logit_mismatch from scored group by run_name"""))
def score_sanity(spark, sf):
    return gates.score_sanity(A.predictions(spark, sf))


@query("advantage_verdict", sql_with("runs", f"""+x as (select case run_id % 3 when 0 then 'neural' when 1 then 'simple_image' else 'geographic' end as family, validation_pr_auc as pr from runs),
b as (select max(case when family = 'neural' then pr end) as neural, max(case when family = 'simple_image' then pr end) as simple_image, max(case when family = 'geographic' then pr end) as geographic from x)
select *, case when neural is null or simple_image is null or geographic is null then 'inconclusive' when neural <= simple_image + 0.02::double then 'no meaningful advantage'
  when neural > simple_image + 0.05::double and neural > geographic + 0.05::double then 'meaningful discrimination' else 'limited advantage' end as verdict from b"""))
def advantage_verdict(spark, sf):
    return gates.advantage_verdict(board(spark, sf))


# what the configuration of the runs promises
RUN_PLAN = {"architecture": 3, "seed": 3, "loss_name": 5, "augmentation": 2}
CANDIDATES, FINALS = 3 * 3 * 5 * 2, 3 * 3


@query("unlock_gate", sql_with("runs", f"""+c as (select count(*) as n from (select distinct architecture, seed, loss_name, augmentation from runs)),
f as (select count(*) as n from (select distinct architecture, seed from runs))
select 'candidate_runs' as criterion, c.n = {CANDIDATES} as pass from c union all select 'final_runs', f.n = {FINALS} from f
union all select case when c.n = {CANDIDATES} and f.n = {FINALS} then 'unlock' else 'locked' end, c.n = {CANDIDATES} and f.n = {FINALS} from c, f"""))
def unlock_gate(spark, sf):
    return gates.unlock_gate(A.runs(spark, sf), RUN_PLAN, ("architecture", "seed"))


GEO_BY_MONTH = """sb2 as (select run_name, month(date) as mo, probability as p, sum(label)::bigint as pos, (count(*) - sum(label))::bigint as neg from predictions where split = 'test' group by all),
sw2 as (select *, sum(pos) over w as cp, sum(pos) over g as ap, sum(neg) over g as an from sb2 window w as (partition by run_name, mo order by p desc), g as (partition by run_name, mo)),
am as (select run_name, mo, sum(neg * (cp - pos / 2.0::double)) / (max(ap) * max(an)) as auc from sw2 group by run_name, mo)"""
# counts of the patch audit that make a patch invalid
DEFECTS = ("missing", "wrong_dimensions", "wrong_channels", "constant", "black", "nonfinite", "hash_mismatch")
FACTS = f"""{DOMINANCE}, {OVERLAP}, {CHECKS}, {FULL}, {GEO_BY_MONTH},
{AUDIT}, ct as (select count(*) as k from (select frame_time, lat, lon from manifest where label = 0) c where exists (select 1 from ground g where g.ts >= c.frame_time - interval '20 minutes' and g.ts < c.frame_time + interval '30 minutes' and {BOX.format(m='10.0')})),
hold as (select min(positive) as positive, min(negative) as negative, min(active_dates) as dates, min(positive_frames) as frames, min(storms) as storms, max(greatest(largest_frame_fraction, largest_date_fraction, largest_storm_fraction)) as share from dom where split in ('val', 'test')),
fa2 as (select (select k from ct) as contamination, (select {' + '.join(DEFECTS)} from au) as invalid, 1 as regenerated, positive, negative, dates, frames, storms, share, (select sum(train_val + train_test + val_test) from ov where kind <> 'sha256') as overlap,
  (select within_split_repeats from ov where kind = 'crop') as crops, (select within_split_repeats from ov where kind = 'path') as paths, (select roc_auc from fm where run_name = 'F' and split = 'test') as geo_auc, (select roc_auc from fm where run_name = 'O' and split = 'test') as image_auc,
  (select min(auc) filter (run_name = 'O') - max(auc) filter (run_name = 'F') from am) as stability, (select sum(violations) from cs where "check" in ('split_mismatch', 'image_after_strike')) as check_violations from hold)"""


def facts(spark, sf):
    """One row of audit numbers, gathered in long form so no tables are crossed."""
    rows = A.manifest(spark, sf)
    hold = summaries.cluster_dominance(rows).where(F.col("split").isin("val", "test")).agg(
        *[F.min(c).cast("double").alias(n) for n, c in (
            ("positive", "positive"), ("negative", "negative"), ("dates", "active_dates"), ("frames", "positive_frames"), ("storms", "storms"))],
        F.max(F.greatest(*SHARES)).alias("share"),
    )
    negatives = rows.where("label = 0").select(F.col("path").alias("candidate_id"), "frame_time", "lat", "lon")
    hit = joins.contamination_audit(negatives, A.ground(spark, sf), [("primary", -20, 30, 10.0)]).select(
        F.col("contaminated").cast("double").alias("contamination")
    )
    pairs = F.col("train_val") + F.col("train_test") + F.col("val_test")
    over = overlap(spark, sf).agg(
        F.sum(F.when(F.col("kind") != "sha256", pairs)).cast("double").alias("overlap"),
        F.max(F.when(F.col("kind") == "crop", F.col("within_split_repeats"))).cast("double").alias("crops"),
        F.max(F.when(F.col("kind") == "path", F.col("within_split_repeats"))).cast("double").alias("paths"),
    )
    test = A.predictions(spark, sf).where("split = 'test'").withColumn("mo", F.month("date"))
    by_month = metrics.score_counts(test, ["run_name", "mo"])
    whole = cut(by_month.groupBy("run_name", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    auc = metrics.areas(whole, ["run_name"]).agg(
        F.max(F.when(F.col("run_name") == "F", F.col("roc_auc"))).alias("geo_auc"),
        F.max(F.when(F.col("run_name") == "O", F.col("roc_auc"))).alias("image_auc"),
    )
    monthly = metrics.areas(by_month, ["run_name", "mo"]).agg(
        (F.min(F.when(F.col("run_name") == "O", F.col("roc_auc"))) - F.max(F.when(F.col("run_name") == "F", F.col("roc_auc")))).alias("stability")
    )
    checks = manifest_checks(spark, sf).where(F.col("check").isin("split_mismatch", "image_after_strike")).agg(
        F.sum("violations").cast("double").alias("check_violations")
    )
    bad = patch_audit(spark, sf).select(sum((F.col(c) for c in DEFECTS), F.lit(0)).cast("double").alias("invalid"))
    same = determinism_check(spark, sf).select(F.col("match").cast("double").alias("regenerated"))
    out = None
    for part in (hold, hit, over, auc, monthly, checks, bad, same):
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


DECISION = {
    "zero_primary_contamination": "contamination = 0",
    "sufficient_holdout_samples": "positive >= 500 and negative >= 500 and dates >= 25 and frames >= 75 and storms >= 30",
    "zero_cross_split_overlap": "overlap = 0", "zero_duplicate_crops": "crops = 0", "zero_invalid_patches": "invalid = 0",
    "manifest_regeneration_deterministic": "regenerated = 1",
    "geographic_auc_below_0_75": "geo_auc < 0.75", "geography_not_competitive_with_image": "geo_auc < image_auc - 0.05",
    "cluster_intervals_stable": "stability > 0.05", "no_dominant_cluster": "share < 0.25",
    "natural_prevalence_created": "positive > 0 and negative > 0", "all_tests_pass": "check_violations = 0",
}
PREFLIGHT = {
    "primary_contamination_zero": "contamination = 0", "cross_split_overlaps_zero": "overlap = 0", "invalid_patch_counts_zero": "invalid = 0",
    "deterministic_manifest_regeneration_passed": "regenerated = 1", "validation_and_test_support_passed": "positive >= 500 and negative >= 500",
    "natural_prevalence_set_exists": "positive > 0", "geographic_auc_below_0_75": "geo_auc < 0.75",
    "geography_at_least_0_05_below_best_image": "image_auc - geo_auc >= 0.05", "clustered_intervals_no_severe_instability": "stability > 0.05",
    "all_earlier_tests_passed": "check_violations = 0",
}


def gate_sql(checks: dict, decision: tuple[str, str]) -> str:
    rows = " union all ".join(f"select '{n}' as criterion, coalesce({c}, false) as pass from fa2" for n, c in checks.items())
    return f"gt as ({rows}) select * from gt union all select case when bool_and(pass) then '{decision[0]}' else '{decision[1]}' end, bool_and(pass) from gt"


@query("decision_gate", sql_with("manifest pixels ground predictions", f"+{FACTS}, {gate_sql(DECISION, ('proceed', 'revise'))}"))
def decision_gate(spark, sf):
    return gates.gate({n: F.expr(c) for n, c in DECISION.items()}, facts(spark, sf), ("proceed", "revise"))


@query("preflight_gate", sql_with("manifest pixels ground predictions", f"+{FACTS}, {gate_sql(PREFLIGHT, ('passed', 'failed'))}"))
def preflight_gate(spark, sf):
    return gates.gate({n: F.expr(c) for n, c in PREFLIGHT.items()}, facts(spark, sf), ("passed", "failed"))


@query("union_by_name", sql_with("strikes", "select solution_key, lat, lon, kind, null as event_type from strikes where kind = 'Ground' union all select solution_key, lat, null, null, event_type from strikes where kind <> 'Ground'"))
def union_by_name(spark, sf):
    rows = A.strikes(spark, sf)
    a = rows.where("kind = 'Ground'").select("solution_key", "lat", "lon", "kind")
    return a.unionByName(rows.where("kind <> 'Ground'").select("solution_key", "lat", "event_type"), allowMissingColumns=True)


@query("distinct_rows", sql_with("strikes", "select source_file, day, solution_key, ts from (select source_file, ts::date::varchar as day, solution_key, ts, row_number() over (partition by source_file, ts::date order by ts, solution_key) as rn from strikes) where rn = 1"))
def distinct_rows(spark, sf):
    rows = A.strikes(spark, sf).select("source_file", F.to_date("ts").alias("day"), "ts", "solution_key")
    return first_per_key(rows, ["source_file", "day"], ["ts", "solution_key"])


@query("set_intersect", sql_with("manifest", "select sha256 from manifest where split = 'train' intersect select sha256 from manifest where split = 'test'"))
def set_intersect(spark, sf):
    rows = A.manifest(spark, sf)
    return rows.where("split = 'train'").select("sha256").intersect(rows.where("split = 'test'").select("sha256"))


@query("set_except", sql_with("manifest", "select sha256 from manifest where split = 'train' except select sha256 from manifest where split = 'test'"))
def set_except(spark, sf):
    rows = A.manifest(spark, sf)
    return rows.where("split = 'train'").select("sha256").subtract(rows.where("split = 'test'").select("sha256"))


@query("stable_sort", sql_with("ground", "select solution_key, ts, lat, lon from ground order by ts, lat, lon, solution_key"))
def stable_sort(spark, sf):
    return A.ground(spark, sf).select("solution_key", "ts", "lat", "lon").orderBy("ts", "lat", "lon", "solution_key")


@query("top_k", sql_with("summary", "select slot as frame_time, n as strike_count from summary order by n desc, slot limit 100"))
def top_k(spark, sf):
    rows = planning.bin_summary(A.ground(spark, sf)).select("frame_time", "strike_count")
    return rows.orderBy(F.desc("strike_count"), "frame_time").limit(100)
