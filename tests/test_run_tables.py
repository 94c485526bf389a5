"""Tables of one row per run never send the predictions of a run to one task."""

import datetime
import re

import pytest

import __spark_entry__ as entry_module
from skyledger.catalog import verify


@pytest.fixture
def lineitem(spark, tmp_path):
    day = datetime.datetime(1996, 1, 1)
    rows = [
        (k % 40, k % 7, k % 5, k % 4, float(k % 50), "RNA"[k % 3], "OF"[k % 2], day + datetime.timedelta(days=k % 9)) for k in range(400)
    ]
    spark.createDataFrame(
        rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name", ["prediction_scan", "loss_values"])
def test_runs_are_broadcast(spark, lineitem, name):
    got = entry_module.queries()[name](spark, lineitem)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.run_name for r in got.collect()} == {"O", "F"}


def test_thresholds_are_broadcast(spark, lineitem):
    got = verify.frozen(spark, lineitem)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the join with the thresholds is the first one from the top; its kind decides where what follows is grouped
    assert re.search(r"\w+Join\b", plan)[0] == "BroadcastHashJoin"
    assert got.count() == 400
