"""Verification queries over predictions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyledger.catalog.base import query, r, rounded, sql_with, steady, u
from skyledger.functions import scores as S
from skyledger.operators import joins, metrics as M
from skyledger.sources import adapters as A

KEYS = ["run_name", "split"]
K = "run_name, split"

SC = "sc as (select run_name, split, probability as p, sum(label)::bigint as pos, (count(*) - sum(label))::bigint as neg from predictions group by all)"


def counts(spark, sf):
    return M.score_counts(A.predictions(spark, sf), KEYS)


def d(a: str, b: str) -> str:
    return f"coalesce(({a})::double / nullif(({b})::double, 0), 0)"


COUNT_METRICS = {
    "accuracy": d("tp + tn", "tp + tn + fp + fn"),
    "balanced_accuracy": f"case when tp + fn = 0 then {d('tn', 'tn + fp')} when tn + fp = 0 then {d('tp', 'tp + fn')} else ({d('tp', 'tp + fn')} + {d('tn', 'tn + fp')}) / 2 end",
    "precision": d("tp", "tp + fp"),
    "recall_pod": d("tp", "tp + fn"),
    "f1": d("2 * tp", "2 * tp + fp + fn"),
    "specificity": d("tn", "tn + fp"),
    "false_positive_rate_fpr": d("fp", "fp + tn"),
    "false_discovery_ratio_far": d("fp", "tp + fp"),
    "mcc": d("tp::double * tn - fp::double * fn", "sqrt((tp + fp)::double) * sqrt((tp + fn)::double) * sqrt((tn + fp)::double) * sqrt((tn + fn)::double)"),
    "hss": d("2 * (tp::double * tn - fp::double * fn)", "(tp + fn)::double * (fn + tn) + (tp + fp)::double * (fp + tn)"),
    "tss": f"{d('tp', 'tp + fn')} - {d('fp', 'fp + tn')}",
}
AREA_METRICS = ["roc_auc", "pr_auc", "brier_score", "expected_calibration_error"]


def full_sql(keys: str, src: str) -> str:
    """CTE ``fm``: every metric per ``keys`` from ``src(keys, p, pos, neg, thr)``."""
    using = keys
    return f"""s_ as (select {keys}, p, thr, sum(pos)::double as pos, sum(neg)::double as neg from {src} group by {keys}, p, thr),
c_ as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over g as ap, sum(neg) over g as an from s_
  window w as (partition by {keys} order by p desc), g as (partition by {keys})),
m_ as (select {keys}, max(thr) as threshold, sum(case when p < thr then neg else 0 end)::bigint as tn, sum(case when p >= thr then neg else 0 end)::bigint as fp,
  sum(case when p < thr then pos else 0 end)::bigint as fn, sum(case when p >= thr then pos else 0 end)::bigint as tp,
  sum(pos * power(p - 1, 2) + neg * power(p, 2)) / sum(pos + neg) as brier_score,
  case when max(ap) > 0 and max(an) > 0 then sum(neg * (cp - pos / 2)) / (max(ap) * max(an)) end as roc_auc,
  case when max(ap) > 0 and max(an) > 0 then sum(pos * cp / (cp + cn)) / max(ap) end as pr_auc from c_ group by {keys}),
e_ as (select {keys}, sum(abs(sp - sy)) / sum(sn) as expected_calibration_error from (select {keys},
  len(list_filter(generate_series(1, 9), lambda i: i * 0.1::double <= p)) as b, sum(p * (pos + neg)) as sp, sum(pos) as sy, sum(pos + neg) as sn
  from s_ group by {keys}, b) group by {keys}),
fm as (select * , {', '.join(f'{v} as {n}' for n, v in COUNT_METRICS.items())} from m_ join e_ using ({using}))"""


CONF = """cm as (select run_name, split, (count(*) filter (label = 0 and probability < 0.5::double))::bigint as tn, (count(*) filter (label = 0 and probability >= 0.5::double))::bigint as fp,
  (count(*) filter (label = 1 and probability < 0.5::double))::bigint as fn, (count(*) filter (label = 1 and probability >= 0.5::double))::bigint as tp from predictions group by all)"""


@query("confusion", sql_with("predictions", f"+{CONF} select * from cm"))
def confusion(spark, sf):
    return M.confusion(A.predictions(spark, sf), KEYS, F.lit(0.5))


@query("classification_metrics", sql_with("predictions", f"+{CONF} select run_name, split, tn, fp, fn, tp, {', '.join(f'round({v}, 6) as {n}' for n, v in COUNT_METRICS.items())} from cm"))
def classification_metrics(spark, sf):
    table = M.confusion(A.predictions(spark, sf), KEYS, F.lit(0.5)).withColumns(S.contingency_metrics())
    return rounded(table, list(COUNT_METRICS))


@query("skill_scores", sql_with("predictions", f"""+{CONF} select run_name, split, round({d('tp', 'tp + fn')}, 6) as pod, round({d('fp', 'tp + fp')}, 6) as far,
  round({d('tp', 'tp + fp + fn')}, 6) as csi, round({d('fp', 'fp + tn')}, 6) as pofd, round({d('tp', 'tp + fn')} - {d('fp', 'fp + tn')}, 6) as tss,
  round({COUNT_METRICS['hss']}, 6) as hss, round({d('(tp + fn)::double * (tp + fp) + (tn + fn)::double * (tn + fp)', 'tp + tn + fp + fn')}, 6) as expected_random from cm"""))
def skill_scores(spark, sf):
    m = S.contingency_metrics()
    columns = {
        "pod": m["recall_pod"], "far": m["false_discovery_ratio_far"], "csi": S.csi(), "pofd": m["false_positive_rate_fpr"],
        "tss": m["tss"], "hss": m["hss"], "expected_random": S.expected_random(),
    }
    return M.confusion(A.predictions(spark, sf), KEYS, F.lit(0.5)).select(
        *KEYS, *[F.round(c, 6).alias(n) for n, c in columns.items()]
    )


FULL = f"{SC},\nsrc as (select *, 0.5::double as thr from sc),\n{full_sql(K, 'src')}"


@query("roc_auc", sql_with("predictions", f"+{FULL} select {K}, round(roc_auc, 9) as roc_auc from fm"))
def roc_auc(spark, sf):
    return rounded(M.areas(counts(spark, sf), KEYS), ["roc_auc"], 9).drop("pr_auc")


@query("pr_auc", sql_with("predictions", f"+{FULL} select {K}, round(pr_auc, 9) as pr_auc from fm"))
def pr_auc(spark, sf):
    return rounded(M.areas(counts(spark, sf), KEYS), ["pr_auc"], 9).drop("roc_auc")


@query("roc_points", sql_with("predictions", f"+{FULL} select {K}, p as threshold, round(cn / an, 9) as fpr, round(cp / ap, 9) as tpr from c_"))
def roc_points(spark, sf):
    c = M.curve(counts(spark, sf), KEYS)
    return c.select(*KEYS, F.col("score").alias("threshold"), F.round(F.col("fp") / F.col("all_neg"), 9).alias("fpr"),
                    F.round(F.col("tp") / F.col("all_pos"), 9).alias("tpr"))


@query("pr_points", sql_with("predictions", f"+{FULL} select {K}, p as threshold, round(cp / ap, 9) as recall, round(cp / (cp + cn), 9) as precision from c_"))
def pr_points(spark, sf):
    c = M.curve(counts(spark, sf), KEYS)
    return c.select(*KEYS, F.col("score").alias("threshold"), F.round(F.col("tp") / F.col("all_pos"), 9).alias("recall"),
                    F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 9).alias("precision"))


@query("brier", sql_with("predictions", f"select {K}, round(avg(power(probability - label, 2)), 9) as brier_score from predictions group by all"))
def brier(spark, sf):
    return A.predictions(spark, sf).groupBy(*KEYS).agg(
        F.round(F.avg(F.pow(F.col("probability") - F.col("label"), F.lit(2.0))), 9).alias("brier_score")
    )


@query("ece", sql_with("predictions", f"+{FULL} select {K}, round(expected_calibration_error, 9) as expected_calibration_error from fm"))
def ece(spark, sf):
    return rounded(M.calibration_error(counts(spark, sf), KEYS), ["expected_calibration_error"], 9)


@query("reliability", sql_with("predictions", f"""select {K}, len(list_filter(generate_series(1, 9), lambda i: i * 0.1::double <= probability))::int as bin, count(*) as n,
  round(avg(probability), 6) as mean_prediction, round(avg(label), 6) as positive_fraction from predictions group by all"""))
def reliability(spark, sf):
    return rounded(M.reliability(counts(spark, sf), KEYS), ["mean_prediction", "positive_fraction"])


MINORITY = f"""{SC},\nsrc as (select {K}, 1.0::double - p as p, neg as pos, pos as neg, 0.5::double as thr from sc),
{full_sql(K, 'src')}"""


@query("minority_metrics", sql_with("predictions", f"""+{MINORITY}, {CONF}
select {K}, round({d('cm.tn', 'cm.tn + cm.fn')}, 6) as precision_no_strike, round({d('cm.tn', 'cm.tn + cm.fp')}, 6) as recall_no_strike,
  round({d('2 * cm.tn', '2 * cm.tn + cm.fn + cm.fp')}, 6) as f1_no_strike, round(fm.pr_auc, 6) as pr_auc_no_strike,
  cm.tn + cm.fp as support_no_strike, cm.tp + cm.fn as support_strike from cm join fm using ({K})"""))
def minority_metrics(spark, sf):
    sc = counts(spark, sf)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    cm = M.confusion(A.predictions(spark, sf), KEYS, F.lit(0.5)).select(
        *KEYS, F.round(S.ratio(tn, tn + fn), 6).alias("precision_no_strike"),
        F.round(S.ratio(tn, tn + fp), 6).alias("recall_no_strike"),
        F.round(S.ratio(2 * tn, 2 * tn + fn + fp), 6).alias("f1_no_strike"),
        (tn + fp).alias("support_no_strike"), (tp + fn).alias("support_strike"),
    )
    area = M.areas(M.minority_counts(sc), KEYS).select(*KEYS, F.round("pr_auc", 6).alias("pr_auc_no_strike"))
    return cm.join(area, KEYS)


@query("constant_baseline", sql_with("predictions", f"""select {K}, round(avg(label), 6) as accuracy, round(avg(label), 6) as base_rate,
  0.0::double as precision_no_strike, 0.0::double as recall_no_strike, 0.0::double as f1_no_strike, round(1 - avg(label), 6) as pr_auc_no_strike from predictions group by all"""))
def constant_baseline(spark, sf):
    rate = F.avg("label")
    return A.predictions(spark, sf).groupBy(*KEYS).agg(
        F.round(rate, 6).alias("accuracy"), F.round(rate, 6).alias("base_rate"),
        *[F.lit(0.0).alias(f"{m}_no_strike") for m in ("precision", "recall", "f1")],
        F.round(F.lit(1.0) - rate, 6).alias("pr_auc_no_strike"),
    )


GRID = [i / 100 for i in range(30, 81)]
SWEEP = """gr as (select i / 100.0::double as threshold from range(30, 81) t(i)),
sw as (select run_name, split, threshold, sum(case when p < threshold then neg else 0 end)::bigint as tn, sum(case when p >= threshold then neg else 0 end)::bigint as fp,
  sum(case when p < threshold then pos else 0 end)::bigint as fn, sum(case when p >= threshold then pos else 0 end)::bigint as tp from sc cross join gr group by all)"""


@query("threshold_sweep", sql_with("predictions", f"""+{SC}, {SWEEP}
select {K}, threshold, tn, fp, fn, tp, round({COUNT_METRICS['precision']}, 6) as precision, round({COUNT_METRICS['recall_pod']}, 6) as recall_pod, round({COUNT_METRICS['f1']}, 6) as f1,
  round({COUNT_METRICS['false_discovery_ratio_far']}, 6) as far from sw"""))
def threshold_sweep(spark, sf):
    m = S.contingency_metrics()
    names = {"precision": "precision", "recall_pod": "recall_pod", "f1": "f1", "far": "false_discovery_ratio_far"}
    return M.sweep(counts(spark, sf), KEYS, GRID).withColumns({n: F.round(m[c], 6) for n, c in names.items()})


def threshold_sql(mode: str) -> str:
    grid = {
        "model": "select 0.0::double as t union all select 1.0::double union all select i * ((0.99::double - 0.01::double) / 98) + 0.01::double from range(98) r(i) union all select 0.99::double union all select p from sc",
        "baseline": "select 0.0::double as t union all select 1.0::double union all select p from sc",
        "grid": "select 0.5::double as t union all select i * ((0.95::double - 0.05::double) / 180) + 0.05::double from range(180) r(i) union all select 0.95::double",
        "pilot": "select i * ((0.99::double - 0.01::double) / 196) + 0.01::double as t from range(196) r(i) union all select 0.99::double",
    }[mode]
    order = {"model": "f1 desc, t desc", "baseline": "f1 desc, t desc", "grid": "f1 desc, (t = 0.5::double) desc, t", "pilot": "f1 desc, t"}[mode]
    return f"""gt_{mode} as (select distinct t from ({grid})),
ev_{mode} as (select run_name, split, t, 2.0 * sum(case when p >= t then pos else 0 end)::double as num,
  (2 * sum(case when p >= t then pos else 0 end) + sum(case when p >= t then neg else 0 end) + sum(case when p < t then pos else 0 end))::double as den
  from sc cross join gt_{mode} where split = 'val' group by all),
best_{mode} as (select run_name, split, t as threshold, f1 from (select *, row_number() over (partition by run_name, split order by {order}) as rn
  from (select *, coalesce(num::double / nullif(den, 0), 0) as f1 from ev_{mode})) where rn = 1)"""


MODES = ("model", "baseline", "grid", "pilot")


@query("select_threshold", sql_with("predictions", f"""+{SC}, {', '.join(threshold_sql(m) for m in MODES)}
{' union all '.join(f"select '{m}' as mode, run_name, split, round(threshold, 9) as threshold, round(f1, 9) as f1 from best_{m}" for m in MODES)}"""))
def select_threshold(spark, sf):
    sc = counts(spark, sf).where("split = 'val'")
    parts = [M.select_threshold(sc, KEYS, m).withColumn("mode", F.lit(m)) for m in MODES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out, ["threshold", "f1"], 9)


def frozen(spark, sf, predictions=None):
    """Predictions of every split with the threshold chosen on validation."""
    chosen = M.select_threshold(counts(spark, sf).where("split = 'val'"), KEYS, "model").select("run_name", "threshold")
    rows = A.predictions(spark, sf) if predictions is None else predictions
    # one row per run: a join by run would leave all that follows to one task a run
    return rows.join(F.broadcast(chosen), "run_name")


FROZEN = f"{SC},\n{threshold_sql('model')},\nsrc as (select sc.run_name, sc.split, p, pos, neg, b.threshold as thr from sc join best_model b on sc.run_name = b.run_name),\n{full_sql(K, 'src')}"
FULL_NAMES = [*COUNT_METRICS, *AREA_METRICS]


@query("apply_frozen_threshold", sql_with("predictions", f"+{FROZEN} select {K}, threshold, tn, fp, fn, tp, {r(FULL_NAMES)} from fm where split <> 'val'"))
def apply_frozen_threshold(spark, sf):
    sc = counts(spark, sf)
    chosen = M.select_threshold(sc.where("split = 'val'"), KEYS, "model").select("run_name", "threshold")
    tests = sc.where("split <> 'val'").join(chosen, "run_name")
    return rounded(M.metric_table(tests, KEYS, F.col("threshold")), FULL_NAMES)


@query("recall_crossing", sql_with("predictions", f"""+{SC}, {SWEEP}, q as (select *, {COUNT_METRICS['recall_pod']} as rec, {COUNT_METRICS['f1']} as f1 from sw)
select {K}, min(case when rec <= 0.9::double then threshold end) as first_at_or_below, round(max(case when threshold = 0.51::double then rec end), 6) as recall_51,
  round(max(case when threshold = 0.51::double then f1 end), 6) as f1_51, round(max(case when threshold = 0.6::double then rec end), 6) as recall_60,
  round(max(case when threshold = 0.65::double then rec end), 6) as recall_65, round(max(case when threshold = 0.7::double then rec end), 6) as recall_70 from q group by all"""))
def recall_crossing(spark, sf):
    m = S.contingency_metrics()
    rows = M.sweep(counts(spark, sf), KEYS, GRID).withColumns({"rec": m["recall_pod"], "f1": m["f1"]})

    def at(t, c):
        return F.round(F.max(F.when(F.col("threshold") == t, F.col(c))), 6)

    return rows.groupBy(*KEYS).agg(
        F.min(F.when(F.col("rec") <= 0.9, F.col("threshold"))).alias("first_at_or_below"), at(0.51, "rec").alias("recall_51"),
        at(0.51, "f1").alias("f1_51"), *[at(t, "rec").alias(f"recall_{int(t * 100)}") for t in (0.6, 0.65, 0.7)],
    )


CLUSTERS = {"date": "date", "frame_id": "frame_id", "storm_id": "storm_id"}


def boot_sql(cluster: str) -> str:
    t = cluster
    return f"""cl_{t} as (select run_name, {t}::varchar as cluster, row_number() over (partition by run_name order by {t}::varchar) as i, count(*) over (partition by run_name) as n
  from (select distinct run_name, {t} from predictions where split = 'test')),
dr_{t} as (select run_name, replicate, floor({u('boot', 'run_name', 'replicate', 'i')} * n)::bigint + 1 as j, count(*) as times from cl_{t} cross join range(1, 501) r(replicate) group by all),
mu_{t} as (select dr.run_name, dr.replicate, cl.cluster, dr.times from dr_{t} dr join cl_{t} cl on dr.run_name = cl.run_name and dr.j = cl.i),
cs_{t} as (select run_name, {t}::varchar as cluster, probability as p, sum(label) as pos, count(*) - sum(label) as neg from predictions where split = 'test' group by all),
sb_{t} as (select '{t}' as cluster_kind, cs.run_name, mu.replicate, cs.p, sum(cs.pos * mu.times) as pos, sum(cs.neg * mu.times) as neg
  from cs_{t} cs join mu_{t} mu on cs.run_name = mu.run_name and cs.cluster = mu.cluster group by all)"""


@query("clustered_bootstrap", sql_with("predictions", f"""+{SC}, {threshold_sql('model')}, {', '.join(boot_sql(c) for c in CLUSTERS)},
src as (select x.*, b.threshold as thr from ({' union all '.join(f'select * from sb_{c}' for c in CLUSTERS)}) x join best_model b on x.run_name = b.run_name),
{full_sql('cluster_kind, run_name, replicate', 'src')},
lg as (unpivot (select cluster_kind, run_name, replicate, {', '.join(M.ALL_METRICS)} from fm) on {', '.join(M.ALL_METRICS)} into name metric value value)
select cluster_kind, run_name, metric, round(quantile_cont(value, 0.025), 6) as lower, round(quantile_cont(value, 0.5), 6) as median,
  round(quantile_cont(value, 0.975), 6) as upper, count(value) as valid_replicates from lg group by all"""))
def clustered_bootstrap(spark, sf):
    rows = frozen(spark, sf, A.predictions(spark, sf).where("split = 'test'"))
    out = None
    for cluster in CLUSTERS:
        part = M.clustered_bootstrap(rows, ["run_name"], cluster).withColumn("cluster_kind", F.lit(cluster))
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["lower", "median", "upper"])


GROUPS = ["date", "frame_id", "storm_id", "frame_category"]


@query("subgroup_metrics", sql_with("predictions", f"""+{SC}, {threshold_sql('model')},
lg as ({' union all '.join(f"select run_name, '{g}' as col, {g}::varchar as val, probability, label from predictions where split = 'test'" for g in GROUPS)}),
src as (select lg.run_name, col, val, probability as p, sum(label) as pos, count(*) - sum(label) as neg, b.threshold as thr from lg join best_model b on lg.run_name = b.run_name group by all),
{full_sql('run_name, col, val', 'src')}
select run_name, col as "column", val as "value", tn + fp + fn + tp as n, {r(FULL_NAMES)} from fm where tn + fp + fn + tp >= 2"""))
def subgroup_metrics(spark, sf):
    rows = frozen(spark, sf, A.predictions(spark, sf).where("split = 'test'"))
    sc = M.subgroup_counts(rows, ["run_name", "threshold"], GROUPS)
    table = M.metric_table(sc, ["run_name", "column", "value"], F.col("threshold"))
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return rounded(table.withColumn("n", n).where(n >= 2), FULL_NAMES).select(
        "run_name", "column", M.group_value().alias("value"), "n", *FULL_NAMES)


@query("subgroup_accuracy", sql_with("predictions", """select run_name, month(date)::int as month, frame_category, round(avg((label = (probability >= 0.5::double)::int)::int), 6) as accuracy,
  count(*) as n from predictions group by all"""))
def subgroup_accuracy(spark, sf):
    rows = S.decide(A.predictions(spark, sf), F.lit(0.5))
    return rows.groupBy("run_name", F.month("date").alias("month"), "frame_category").agg(
        F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def temperature_sql(rounds: int = 4, steps: int = 40) -> str:
    low, high = repr(math.log(0.05)), repr(math.log(20.0))
    parts = [
        "lc as (select run_name, logit, label, count(*) as n from scored where split = 'val' group by all)",
        f"st0 as (select distinct run_name, {low}::double as lo, {high}::double as hi from lc)",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"ls{i} as (select s.run_name, lo, hi, lo + i * (hi - lo) / {steps}::double as log_t, "
            f"sum(((1 - label) * z + ln(1 + exp(-abs(z))) + greatest(-z, 0)) * n) / sum(n) as loss from (select lc.*, s.lo, s.hi, g.i, "
            f"lc.logit / exp(s.lo + g.i * (s.hi - s.lo) / {steps}::double) as z from lc join st{i - 1} s on lc.run_name = s.run_name cross join range({steps + 1}) g(i)) s group by all)"
        )
        parts.append(
            f"st{i} as (select run_name, greatest(log_t - (hi - lo) / {steps}::double, {low}::double) as lo, least(log_t + (hi - lo) / {steps}::double, {high}::double) as hi, log_t, loss "
            f"from (select *, row_number() over (partition by run_name order by loss, log_t) as rn from ls{i}) where rn = 1)"
        )
    return ",\n".join(parts)


@query("temperature_fit", sql_with("scored", f"+{temperature_sql()} select run_name, round(exp(log_t), 5) as temperature, round(loss, 9) as loss from st4"))
def temperature_fit(spark, sf):
    fit = M.temperature_fit(A.predictions(spark, sf).where("split = 'val'"), ["run_name"])
    return fit.withColumns({"temperature": F.round("temperature", 5), "loss": F.round("loss", 9)})


@query("calibrated_metrics", sql_with("scored", f"""+{temperature_sql()},
src as (select s.run_name, s.split, round(1 / (1 + exp(-s.logit / round(exp(t.log_t), 5))), 9) as p, label::bigint as pos, (1 - label)::bigint as neg, 0.5::double as thr from scored s join st4 t on s.run_name = t.run_name where s.split <> 'val'),
{full_sql(K, 'src')} select {K}, tn, fp, fn, tp, {r(FULL_NAMES)} from fm"""))
def calibrated_metrics(spark, sf):
    rows = A.predictions(spark, sf)
    fit = M.temperature_fit(rows.where("split = 'val'"), ["run_name"]).select("run_name", F.round("temperature", 5).alias("temperature"))
    z = F.col("logit") / F.col("temperature")
    scaled = rows.where("split <> 'val'").join(F.broadcast(fit), "run_name").withColumn("calibrated", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 9))
    table = M.metric_table(M.score_counts(scaled, KEYS, "calibrated"), KEYS, F.lit(0.5))
    return rounded(table, FULL_NAMES).drop("threshold")


FOCAL = {"focal_constant": (0.25, False), "focal_class": (0.25, True)}


@query("loss_values", sql_with("scored", f"""+pw as (select run_name, (count(*) - sum(label))::double / sum(label) as w from scored where split = 'train' group by all),
z as (select s.*, pw.w, ln(1 + exp(-abs(logit))) + greatest(-logit, 0) as sp, least(greatest(probability, 1e-7::double), 1 - 1e-7::double) as q from scored s join pw on s.run_name = pw.run_name)
select run_name, split, round(avg((1 - label) * logit + sp), 6) as bce, round(avg((1 - label) * logit + (1 + (w - 1) * label) * sp), 6) as bce_pos_weight,
  round(avg(-0.25::double * power(1 - case when label = 1 then q else 1 - q end, 2) * ln(case when label = 1 then q else 1 - q end)), 6) as focal_constant,
  round(avg(-(case when label = 1 then 0.25::double else 0.75::double end) * power(1 - case when label = 1 then q else 1 - q end, 2) * ln(case when label = 1 then q else 1 - q end)), 6) as focal_class
  from z group by all"""))
def loss_values(spark, sf):
    rows = A.predictions(spark, sf)
    weight = rows.where("split = 'train'").groupBy("run_name").agg((F.sum(1 - F.col("label")) / F.sum("label")).alias("w"))
    p = F.least(F.greatest(F.col("probability"), F.lit(1e-7)), F.lit(1 - 1e-7))
    # one row per run: the predictions stay where they are read
    return rows.join(F.broadcast(weight), "run_name").groupBy(*KEYS).agg(
        F.round(F.avg(S.log_loss(F.col("logit"), F.col("label"))), 6).alias("bce"),
        F.round(F.avg(S.log_loss(F.col("logit"), F.col("label"), F.col("w"))), 6).alias("bce_pos_weight"),
        *[F.round(F.avg(S.focal_loss(p, F.col("label"), a, 2.0, c)), 6).alias(n) for n, (a, c) in FOCAL.items()],
    )


@query("leakage_delta", sql_with("predictions", f"""+{FULL}, lg as (unpivot (select run_name, accuracy, precision, recall_pod, f1, roc_auc, pr_auc from fm where split = 'test')
  on accuracy, precision, recall_pod, f1, roc_auc, pr_auc into name metric value value),
pv as (select metric, max(case when run_name = 'O' then value end) as leaky, max(case when run_name = 'F' then value end) as clean from lg group by metric)
select metric, round(leaky, 6) as leaky, round(clean, 6) as clean, round(leaky - clean, 6) as delta,
  case when metric <> 'recall_pod' then null when leaky - clean > 0.5::double then 'large' when leaky - clean > 0.1::double then 'moderate' else 'small' end as severity from pv"""))
def leakage_delta(spark, sf):
    names = ["accuracy", "precision", "recall_pod", "f1", "roc_auc", "pr_auc"]
    table = M.metric_table(counts(spark, sf).where("split = 'test'"), KEYS, F.lit(0.5))
    wide = M.long_metrics(table, ["run_name"], names).groupBy("metric").pivot("run_name", ["O", "F"]).agg(F.max("value"))
    wide = wide.select("metric", F.col("O").alias("leaky"), F.col("F").alias("clean"))
    delta = F.col("leaky") - F.col("clean")
    severity = F.when(F.col("metric") != "recall_pod", None).when(delta > 0.5, "large").when(delta > 0.1, "moderate").otherwise("small")
    return wide.withColumn("delta", delta).withColumn("severity", severity).withColumns(
        {c: F.round(c, 6) for c in ("leaky", "clean", "delta")}
    )


COMPARE = ["accuracy", "f1", "roc_auc", "pr_auc"]


@query("model_comparison", sql_with("predictions", f"""+{FULL}
select run_name as model, 'neural' as source, {r(COMPARE)}, null::double as base_rate from fm where split = 'test'
union all select 'constant_' || run_name, 'baseline', round(avg(label), 6), null, null, null, round(avg(label), 6) from predictions where split = 'test' group by run_name"""))
def model_comparison(spark, sf):
    neural = M.metric_table(counts(spark, sf).where("split = 'test'"), KEYS, F.lit(0.5)).select(
        F.col("run_name").alias("model"), F.lit("neural").alias("source"), *[F.round(c, 6).alias(c) for c in COMPARE]
    )
    constant = A.predictions(spark, sf).where("split = 'test'").groupBy("run_name").agg(F.round(F.avg("label"), 6).alias("accuracy"))
    baseline = constant.select(
        F.concat(F.lit("constant_"), "run_name").alias("model"), F.lit("baseline").alias("source"), "accuracy",
        F.col("accuracy").alias("base_rate"),
    )
    return neural.unionByName(baseline, allowMissingColumns=True)


@query("frozen_threshold_check", sql_with("predictions", f"""+{SC}, {threshold_sql('model')}
select run_name, threshold, case when run_name = 'O' then threshold else threshold + 0.01::double end as recorded_threshold, run_name = 'O' as "match" from best_model"""))
def frozen_threshold_check(spark, sf):
    used = M.select_threshold(counts(spark, sf).where("split = 'val'"), KEYS, "model").select("run_name", "threshold")
    recorded = used.withColumn(
        "threshold", F.when(F.col("run_name") == "O", F.col("threshold")).otherwise(F.col("threshold") + 0.01)
    )
    return joins.frozen_threshold_check(used, recorded)


@query("reported_metric_check", sql_with("predictions", f"""+{FULL}, lg as (unpivot (select {K}, {', '.join(FULL_NAMES)} from fm) on {', '.join(FULL_NAMES)} into name metric value value)
select {K}, metric, round(value, 6) as computed, round(case when split = 'val' then value + 0.5::double else value end, 6) as reported, split <> 'val' as "match" from lg"""))
def reported_metric_check(spark, sf):
    table = M.metric_table(counts(spark, sf), KEYS, F.lit(0.5))
    computed = M.long_metrics(table, KEYS, FULL_NAMES)
    reported = computed.withColumn("value", F.when(F.col("split") == "val", F.col("value") + 0.5).otherwise(F.col("value")))
    return rounded(joins.reported_metric_check(computed, reported, KEYS, 1e-9), ["computed", "reported"])
