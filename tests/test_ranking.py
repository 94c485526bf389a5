import random

import numpy as np
from pyspark.sql import functions as F

from skyledger.operators import ranking


def test_global_rank_with_one_hot_group(spark):
    random.seed(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", random.random(), i) for i in range(900)]
    got = ranking.global_rank(spark.createDataFrame(rows, "g string, v double, i int"), ["g"], ["v", "i"], "r").collect()
    for g in {r[0] for r in rows}:
        order = sorted((r[1], r[2]) for r in rows if r[0] == g)
        mine = {r["i"]: r["r"] for r in got if r["g"] == g}
        assert [mine[i] for _, i in order] == list(range(1, len(order) + 1))


def test_running_totals_and_quantiles(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=600), 2)
    df = spark.createDataFrame([("a" if i % 4 else "b", float(v)) for i, v in enumerate(values)], "g string, v double")
    totals = ranking.value_totals(df, ["g"], "v", {"n": F.count(F.lit(1))}).collect()
    for r in totals:
        mine = [v for i, v in enumerate(values) if ("a" if i % 4 else "b") == r["g"]]
        assert r["cum_n"] == sum(v <= r["v"] for v in mine) and r["all_n"] == len(mine)
    got = {r["g"]: r for r in ranking.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "q9": 0.9, "lo": 0.0, "hi": 1.0}).collect()}
    for g in "ab":
        mine = [v for i, v in enumerate(values) if ("a" if i % 4 else "b") == g]
        for name, p in (("q1", 0.25), ("q9", 0.9), ("lo", 0.0), ("hi", 1.0)):
            assert abs(got[g][name] - np.quantile(mine, p)) < 1e-9


def test_take_per_group_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = ranking.take_per_group(df, ["g"], ["id"], 5)
    assert out.count() == 15
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_take_per_group_beyond_the_limit(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), "id")
    assert ranking.take_per_group(df, ["g"], [F.desc("id")], 1500).agg(F.min("id")).first()[0] == 1000
    assert ranking.take_per_group(df, [F.lit(1)], ["id"], 1500).agg(F.max("id")).first()[0] == 1499
