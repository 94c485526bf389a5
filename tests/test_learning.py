"""Baseline models whose session, number or size once stopped them."""

from functools import partial
from threading import Barrier

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from skyledger.operators import learning, metrics


@pytest.fixture
def rows(spark):
    shaped = spark.range(120).select(
        (F.col("id") % 2).cast("int").alias("label"), ((F.col("id") * 7 % 120) / 10).alias("lat"),
        F.when(F.col("id") < 80, "train").otherwise("val").alias("split"),
    )
    return shaped.withColumn("lon", F.col("lat") + F.col("label"))


@pytest.mark.parametrize("fit", [learning.fit_logistic, partial(learning.fit_forest, trees=3)])
def test_models_score_in_an_observed_session(spark, rows, fit):
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get == {"n": 120}
    scored = learning.score(fit(rows.where("split = 'train'"), ["lat", "lon"]), rows)
    assert scored.where("probability between 0 and 1").count() == 120


def test_models_do_not_wait_for_each_other(spark, rows, tmp_path):
    train, meet = rows.where("split = 'train'"), Barrier(2, timeout=60)

    def fit(features):
        meet.wait()
        return learning.fit_logistic(train, features)

    models = [("a", partial(fit, ["lat"])), ("b", partial(fit, ["lat", "lon"]))]
    table = learning.write_scores(models, rows.where("split = 'val'"), ["lat"], str(tmp_path / "scores"))
    assert table.columns == ["model", "lat", "label", "split", "probability"]
    assert {r["model"]: r["count"] for r in table.groupBy("model").count().collect()} == {"a": 40, "b": 40}


def test_many_training_rows_are_spread_over_the_cores(spark, rows, monkeypatch):
    monkeypatch.setattr(learning, "FEW_ROWS", 10, raising=False)
    sizes, fit = [], learning.Pipeline.fit
    monkeypatch.setattr(learning.Pipeline, "fit", lambda self, df: sizes.append(df.rdd.glom().map(len).collect()) or fit(self, df))
    learning.fit_forest(rows.where("split = 'train'").coalesce(1), ["lat", "lon"], trees=2)
    # 80 rows of two labels that come from one task, on four cores
    assert sum(sizes[0]) == 80 and max(sizes[0]) < 40


def test_replicates_are_summed_in_bounded_groups(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    add = metrics._add

    def counted(cells):
        step = add(cells)

        def one(table):
            if table.num_rows > 60:
                sizes.add(1)
            return step(table)

        return one

    monkeypatch.setattr(metrics, "_add", counted)
    monkeypatch.setattr(metrics, "BUCKET_ROWS", 10)
    df = spark.range(400).select(
        F.lit("r").alias("run"), (F.col("id") % 40).cast("string").alias("c"), (F.col("id") % 2).cast("int").alias("label"),
        (F.col("id") / 400).alias("probability"), F.lit(0.5).alias("threshold"))
    got = metrics.clustered_bootstrap(df, ["run"], "c", repeats=5, metrics=["roc_auc"]).collect()
    assert len(got) == 1 and sizes.value == 0
