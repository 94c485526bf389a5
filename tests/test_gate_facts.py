"""The facts of the gates come from one count of the scores."""

import datetime

from pyspark.sql import functions as F

from skyledger.catalog import audits
from skyledger.operators import metrics
from skyledger.sources import adapters as A


def test_scores_are_counted_once(spark, tmp_path, monkeypatch):
    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame(
        [(k, k % 7, k % 5, k % 4, float(k % 50), "RNA"[k % 3], "OF"[k % 2], day + datetime.timedelta(days=k % 60)) for k in range(600)],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(
        [(k, day + datetime.timedelta(hours=7 * k), k % 11, ["click", "view", "error"][k % 3], float(k % 100), "") for k in range(60)],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k, [0.1 * (k % 5)] * 64, k % 10) for k in range(6)], "vec_id bigint, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    calls, count = [], metrics.score_counts
    monkeypatch.setattr(metrics, "score_counts", lambda *a, **k: calls.append(a) or count(*a, **k))
    got = audits.facts(spark, str(tmp_path)).first()
    assert len(calls) == 1

    test = A.predictions(spark, str(tmp_path)).where("split = 'test'").withColumn("mo", F.month("date"))
    whole = {r.run_name: r.roc_auc for r in metrics.areas(count(test, ["run_name"]), ["run_name"]).collect()}
    monthly = metrics.areas(count(test, ["run_name", "mo"]), ["run_name", "mo"]).collect()
    assert (got.geo_auc, got.image_auc) == (whole["F"], whole["O"])
    assert got.stability == min(r.roc_auc for r in monthly if r.run_name == "O") - max(r.roc_auc for r in monthly if r.run_name == "F")
