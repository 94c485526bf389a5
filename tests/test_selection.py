import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.operators import selection
from skyledger.plans import planning
from tests.test_joins import at, km, strikes


def greedy_thin(rows, spacing, cap):
    kept = []
    for m, la, lo in sorted(rows):
        if len(kept) < cap and all(km(la, lo, a, o) >= spacing for _, a, o in kept):
            kept.append((m, la, lo))
    return kept


def test_spaced_strikes_in_chunks(spark):
    random.seed(4)
    rows = [(random.random() * 600, 1.2 + random.random() * 3, 99.7 + random.random() * 3) for _ in range(400)]
    df = strikes(spark, rows).withColumn("frame", F.lit("f"))
    for chunk in (512, 7, 60):
        kept = selection.spaced_strikes(df, "frame", 30.0, 20, chunk).first()["kept"]
        got = [(p["lat"], p["lon"]) for p in kept]
        # times lose nothing below a microsecond, so the order is that of the input
        assert got == [(la, lo) for _, la, lo in greedy_thin(rows, 30.0, 20)]


def test_dedup_keeps_first(spark):
    df = strikes(spark, [(0, 1.000001, 100.0), (0, 1.000002, 100.0), (1, 1.0, 100.0)])
    assert sorted(r.solution_key for r in selection.dedup_strikes(df).collect()) == ["k0", "k2"]


def test_interleave_matches_the_greedy_loop(spark):
    random.seed(5)
    weights = {"train": 0.70, "val": 0.15, "test": 0.15}
    sizes = {"train": 23, "val": 4, "test": 9}
    rows, i = [], 0
    for split, n in sizes.items():
        for _ in range(n):
            rows.append((split, at(i)))
            i += 1
    df = spark.createDataFrame(rows, "split string, frame_time timestamp")
    got = [r.frame_time for r in selection.interleave(df, weights).orderBy("turn", "turn_split").collect()]
    queues = {s: [t for k, t in rows if k == s] for s in weights}
    emitted, want = Counter(), []
    while any(queues.values()):
        s = min((k for k in queues if queues[k]), key=lambda k: (emitted[k] / weights[k], list(weights).index(k)))
        want.append(queues[s].pop(0))
        emitted[s] += 1
    assert got == want


def test_stratified_pick_matches_the_greedy_loop(spark):
    random.seed(6)
    rows = [(f"s{random.randrange(5)}", random.random() < 0.3, f"k{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "stratum string, cached boolean, key string")
    from skyledger.functions.hashing import hash_order

    order = {r.key: r.h for r in df.select("key", hash_order("x", "key").alias("h")).collect()}
    want, count = [], Counter()
    for level in (True, False):
        pool = {s: sorted((order[k], k) for t, c, k in rows if t == s and c == level) for s in {r[0] for r in rows}}
        while len(want) < 40 and any(pool.values()):
            s = min((k for k in pool if pool[k]), key=lambda k: (count[k], k))
            want.append(pool[s].pop(0)[1])
            count[s] += 1
    got = [r.key for r in selection.stratified_pick(df, 40, "x", "key").collect()]
    assert sorted(got) == sorted(want)


def candidates(n, seed):
    random.seed(seed)
    rows = []
    for i in range(n):
        t = datetime(2024, 1, 1) + timedelta(minutes=10 * i)
        rows.append((
            random.choice(["train", "test"]), t, f"d{random.randrange(12)}", f"s{random.randrange(40)}", random.randrange(1, 4),
            random.choice("abcd"), random.random() < 0.3, random.randrange(1, 15), random.random(),
        ))
    return rows


SCHEMA = (
    "split string, frame_time timestamp, date string, storm_id string, month int, local_time_block string, "
    "cached boolean, retained int, random double"
)


def in_order(picks):
    return [(r.split, r.epoch) for r in picks.orderBy("split", "pick").collect()]


def test_select_active_matches_the_greedy_loop(spark):
    rows = candidates(400, 7)
    quotas = {"train": 60, "test": 25}
    picks = in_order(selection.select_active(spark.createDataFrame(rows, SCHEMA), quotas, batch=3))
    for split, n in quotas.items():
        left, dates, storms, mix, want = [r for r in rows if r[0] == split], Counter(), Counter(), Counter(), []
        for _ in range(n):
            best = max(left, key=lambda r: 120 * (not dates[r[2]]) + 80 * (not storms[r[3]]) - 18 * mix[r[4], r[5]]
                       + 3 * min(r[7], 10) + 10 * r[6] + r[8])
            left.remove(best)
            dates[best[2]] += 1
            storms[best[3]] += 1
            mix[best[4], best[5]] += 1
            want.append(int((best[1] - datetime(1970, 1, 1)).total_seconds()))
        assert [e for s, e in picks if s == split] == want


def test_select_zero_matches_the_greedy_loop(spark):
    rows = candidates(300, 8)
    quotas = {"train": 40, "test": 10}
    mix = {f"{s}|{m}|{b}": 1 / 12 for s in quotas for m in (1, 2, 3) for b in "abc"}
    shares = spark.createDataFrame([(k[: k.index("|")], k, v) for k, v in mix.items()], "split string, mix string, share double")
    picks = in_order(selection.select_zero(spark.createDataFrame(rows, SCHEMA), quotas, shares))
    for split, n in quotas.items():
        left, dates, seen, want = [r for r in rows if r[0] == split], set(), Counter(), []
        for _ in range(n):
            best = max(left, key=lambda r: 100 * (mix.get(f"{split}|{r[4]}|{r[5]}", 0) - seen[r[4], r[5]] / n)
                       + 20 * (r[2] not in dates) + 10 * r[6] + r[8])
            left.remove(best)
            dates.add(best[2])
            seen[best[4], best[5]] += 1
            want.append(int((best[1] - datetime(1970, 1, 1)).total_seconds()))
        assert [e for s, e in picks if s == split] == want


def test_greedy_with_nulls_ties_small_pools_and_no_rows(spark):
    t = datetime(2024, 1, 1)
    rows = [("train", t + timedelta(minutes=10 * i), None, None, 1, "a", False, 1, 0.5) for i in range(5)]
    pool = spark.createDataFrame(rows, SCHEMA)
    got = selection.select_active(pool, {"train": 9, "val": 3, "none": 0}, batch=1).orderBy("pick").collect()
    assert [(r.split, r.pick) for r in got] == [("train", i) for i in range(1, 6)]
    assert [r.epoch for r in got] == sorted(r.epoch for r in got)
    assert selection.select_active(pool.where("false"), {"train": 9}).count() == 0


def test_a_frozen_plan_is_guarded(spark):
    rows = spark.createDataFrame(
        [(*r, "active" if i % 2 else "zero_recorded") for i, r in enumerate(candidates(200, 9))], SCHEMA + ", category string"
    ).drop("random")
    protocol = planning.Protocol({"train": (10, 5), "test": (4, 2)})
    plan = planning.frozen_plan(rows, protocol).cache()
    digest = planning.plan_digest(plan)
    assert plan.count() == 21 and planning.plan_digest(plan.repartition(7)) == digest
    assert planning.require_frozen(plan, protocol, digest) is plan
    with pytest.raises(ValueError, match="changed"):
        planning.require_frozen(plan.where("pick > 1"), protocol, digest)
    with pytest.raises(ValueError, match="protocol"):
        planning.require_frozen(plan, planning.Protocol({"train": (10, 6)}), digest)


def test_early_stop(spark):
    losses = [(1, 0.5, 0.9), (2, 0.6, 0.8), (3, 0.6, 0.7), (4, 0.6, 0.7), (5, 0.5, 0.1), (6, 0.4, 0.1), (7, 0.9, 0.1)]
    df = spark.createDataFrame([("r", *x) for x in losses], "run string, epoch bigint, pr_auc double, loss double")
    got = selection.early_stop(df, "run", "epoch", 3).first()
    assert (got.best_epoch, got.stop_epoch) == (3, 6)


def test_primary_runs(spark):
    rows = []
    for arch in ("a", "b"):
        for loss in ("x", "y"):
            for seed in range(3):
                rows.append((f"{arch}{loss}{seed}", arch, seed, loss, "none", 0.5 + (loss == "y") * 0.1, 0.3))
    rows.append(("az0", "a", 0, "z", "none", 0.99, 0.1))  # incomplete over seeds
    df = spark.createDataFrame(rows, "run_name string, architecture string, seed int, loss_name string, augmentation string, validation_pr_auc double, validation_loss double")
    got = sorted(r.run_name for r in selection.primary_runs(df, 3).collect())
    assert got == ["ay0", "ay1", "ay2", "by0", "by1", "by2"]
