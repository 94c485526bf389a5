import collections
import random

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from skyledger.functions import scores
from skyledger.operators import metrics


def table(spark, pairs):
    return spark.createDataFrame([("r", y, p) for y, p in pairs], "run string, label int, probability double")


def test_published_counts_give_published_scores(spark):
    row = spark.createDataFrame([(1934, 53, 69, 689)], "tn bigint, fp bigint, fn bigint, tp bigint").withColumns(
        scores.contingency_metrics()
    ).first()
    for name, value in (("accuracy", 0.955556), ("mcc", 0.88819), ("hss", 0.88810), ("tss", 0.88230)):
        assert row[name] == pytest.approx(value, abs=6e-6)
    row = spark.createDataFrame([(1991, 318, 100, 2209)], "tn bigint, fp bigint, fn bigint, tp bigint").select(
        scores.csi().alias("csi"), *[c.alias(n) for n, c in scores.contingency_metrics().items()]
    ).first()
    assert row["csi"] == pytest.approx(0.84088, abs=1e-5) and row["f1"] == pytest.approx(0.91356, abs=1e-5)


def test_csi_of_four_rows(spark):
    df = table(spark, [(1, 0.9), (1, 0.4), (0, 0.8), (0, 0.1)])
    row = metrics.confusion(df, ["run"], F.lit(0.5)).select(scores.csi().alias("csi")).first()
    assert row.csi == pytest.approx(1 / 3)


def test_areas_against_pairs_with_ties(spark):
    random.seed(11)
    pairs = [(int(random.random() < 0.3), round(random.random(), 1)) for _ in range(200)] + [(1, 0.0), (0, 1.0)]
    got = metrics.areas(metrics.score_counts(table(spark, pairs), ["run"]), ["run"]).first()
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    roc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got.roc_auc == pytest.approx(roc)
    ap, last = 0.0, 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        tp, hit = sum(p >= t for p in pos), sum(p >= t for _, p in pairs)
        ap += (tp / len(pos) - last) * tp / hit
        last = tp / len(pos)
    assert got.pr_auc == pytest.approx(ap)


def test_single_class_has_no_area(spark):
    got = metrics.areas(metrics.score_counts(table(spark, [(1, 0.2), (1, 0.7)]), ["run"]), ["run"]).first()
    assert got.roc_auc is None and got.pr_auc is None


def test_threshold_rules(spark):
    counts = metrics.score_counts(table(spark, [(1, 0.9), (1, 0.7), (0, 0.6), (0, 0.1)]), ["run"])
    pick = {m: metrics.select_threshold(counts, ["run"], m).first().threshold for m in ("model", "baseline", "grid", "pilot")}
    assert pick["model"] == pytest.approx(0.7) and pick["baseline"] == pytest.approx(0.7)  # last maximum
    assert 0.6 < pick["grid"] <= 0.7 and pick["grid"] == pytest.approx(0.605)  # first maximum
    assert 0.6 < pick["pilot"] < 0.61
    flat = metrics.score_counts(table(spark, [(1, 0.9), (0, 0.1)]), ["run"])
    assert metrics.select_threshold(flat, ["run"], "grid").first().threshold == 0.5  # .5 must be beaten


def test_sensitivity_rows(spark):
    counts = metrics.score_counts(table(spark, [(0, 0.1), (1, 0.4), (0, 0.6), (1, 0.9)]), ["run"])
    rows = {r.threshold: r for r in metrics.sweep(counts, ["run"], [0.3, 0.5, 0.7]).collect()}
    assert rows[0.3].fp / (rows[0.3].tp + rows[0.3].fp) == pytest.approx(1 / 3)
    assert rows[0.5].tp / (rows[0.5].tp + rows[0.5].fn) == 0.5


def test_bootstrap_of_one_cluster_is_the_estimate(spark):
    df = table(spark, [(1, 0.9), (1, 0.4), (0, 0.8), (0, 0.1)]).withColumns({"c": F.lit("x"), "threshold": F.lit(0.5)})
    rows = metrics.clustered_bootstrap(df, ["run"], "c", repeats=20).collect()
    got = {r.metric: (r.lower, r.upper, r.valid_replicates) for r in rows}
    assert got["accuracy"] == (0.5, 0.5, 20)


def test_replicates_meet_draws_as_vectors_not_as_rows(spark):
    # repeated clusters, two groups, a null cluster (it is drawn but has no rows to weigh)
    raw = [("a", f"c{i % 7}", i % 3 % 2, (i % 5) / 5) for i in range(60)] + [("b", None if i < 3 else f"c{i}", i % 2, i / 9) for i in range(9)]
    df = spark.createDataFrame(raw, "run string, c string, label int, probability double").withColumn("threshold", F.lit(0.5))
    counts = metrics.score_counts(df.withColumn("cluster", F.col("c")), ["run", "cluster", "threshold"])
    clusters, draws = metrics.bootstrap_draws(df, ["run"], "c", 30, "boot")
    got = metrics.clustered_counts(counts, clusters, draws, ["run", "threshold", "score"], 30)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    times, named = collections.Counter((r.id, r.replicate) for r in draws.collect()), {r.id: (r.run, r.cluster) for r in clusters.collect()}
    assert sum(times.values()) == 30 * len(named) == 30 * 14
    want = collections.Counter()
    for (number, replicate), n in times.items():
        for run, c, label, p in raw:
            if (run, c) == named[number] and c is not None:
                want[run, p, replicate, label] += n
    have = {(r.run, r.score, r.replicate, y): v for r in got.collect() for y, v in ((1, r.pos), (0, r.neg)) if v}
    assert have == dict(want)


def test_draws_travel_as_about_a_byte_each(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PIECE", 100)
    df = spark.range(900).select(F.when(F.col("id") < 10, "a").otherwise("b").alias("run"), F.col("id").cast("string").alias("c"))
    _, draws = metrics.bootstrap_draws(df, ["run"], "c", 20, "boot")
    want = collections.Counter((r.id, r.replicate) for r in draws.collect())
    packed = draws.mapInArrow(metrics._pack(2), "_bucket bigint, replicate int, places binary").toArrow()
    assert sum(want.values()) == 20 * 900 and sum(len(v) for v in packed["places"].to_pylist()) < 2 * 20 * 900
    have = {}
    for bucket in (0, 1):
        times = metrics._times(packed.filter(pc.equal(packed["_bucket"], bucket)), 20, 451)
        have |= {(place * 2 + bucket, r + 1): int(times[place, r]) for place, r in zip(*times.nonzero())}
    assert have == dict(want)


def test_sums_of_any_size_and_sign_survive_narrowing():
    sums = np.array([[0, 127], [-1, 128], [2**31, -2**31], [2**62, 0]])
    vectors = metrics._narrow(sums).to_pylist()
    assert (metrics._wide(vectors) == sums).all() and [len(v) for v in vectors] == [3, 5, 17, 17]


def test_temperature(spark):
    # logits twice too large: half the odds of the labels
    pairs = [(1, 2.0)] * 73 + [(0, 2.0)] * 27 + [(0, -2.0)] * 73 + [(1, -2.0)] * 27
    df = spark.createDataFrame([("r", y, z) for y, z in pairs], "run string, label int, logit double")
    import math

    want = 2.0 / math.log(73 / 27)
    assert metrics.temperature_fit(df, ["run"]).first().temperature == pytest.approx(want, rel=1e-3)
