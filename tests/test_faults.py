"""Faults that once lost data or let a gate pass."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.operators import components, gates, joins, metrics, planning, raster
from skyledger.sources import files


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_header_is_the_first_line_whatever_the_rows_say(spark, tmp_path):
    _write(tmp_path / "2024/a/01/02/raw data all.csv",
           "Date/Time,Latitude,Longitude,Amplitude,Cloud or Ground,Note\n"
           "2024-01-01 00:00:00Z,3.0,101.0,1,Ground,\"At Latitude 3, north\"\n"
           "Date/Time,Latitude,Longitude,Amplitude,Cloud or Ground,Note\n")
    _write(tmp_path / "2024/b/01/02/raw data all.csv", "Longitude,Cloud or Ground,Date/Time,Latitude\n102.0,Cloud,2024-01-01 00:10:00Z,4.0\n")
    _write(tmp_path / "2024/c/01/02/raw data all.csv", "when,where\n1,2\n")
    rows = files.scan_strikes(spark, str(tmp_path)).orderBy("Longitude").collect()
    assert [(r["Latitude"], r["Longitude"], r["Cloud or Ground"], r["Note"]) for r in rows] == [
        ("3.0", "101.0", "Ground", "At Latitude 3, north"), ("4.0", "102.0", "Cloud", None), ("Latitude", "Longitude", "Cloud or Ground", "Note")]
    inventory = {r["source_file"].split("/")[-4]: r for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert [inventory[k]["status"] for k in "abc"] == ["valid", "valid", "invalid"]
    assert inventory["a"]["row_count"] == 2 and inventory["a"]["invalid_timestamp_count"] == 1


def test_storm_numbers_are_never_cut(spark):
    made = spark.range(1).select(F.format_string("%06d", F.lit(1_000_000)), F.format_string("%06d", F.lit(7))).first()
    assert tuple(made) == ("1000000", "000007")
    active = spark.createDataFrame([("2024-01-01 00:00:00", 3.0, 101.0), ("2024-01-05 00:00:00", 3.0, 101.0)], "frame_time string, centroid_lat double, centroid_lon double")
    ids = components.storm_groups(active.withColumn("frame_time", F.col("frame_time").cast("timestamp"))).select("storm_id").collect()
    assert sorted(r[0] for r in ids) == ["DERIVED_STORM_000000", "DERIVED_STORM_000001"]


def test_position_split_cuts_at_whole_positions(spark):
    for n, want in ((13, (9, 2, 2)), (19, (13, 3, 3)), (33, (23, 5, 5))):
        rows = planning.split_by_position(spark.range(n).select(F.col("id").cast("string").alias("k")), "s", "k")
        got = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
        assert (got["train"], got["val"], got["test"]) == want


def test_gate_locks_when_a_setting_is_missing(spark):
    rows = pd.DataFrame([(a, s) for a in "xy" for s in (1, 2, 3)], columns=["architecture", "seed"])
    plan = {"architecture": 2, "seed": 3}

    def last(frame):
        return [r["criterion"] for r in gates.unlock_gate(spark.createDataFrame(frame), plan, ("architecture", "seed")).collect()][-1]

    assert last(rows) == "unlock"
    assert last(rows[rows.architecture == "x"]) == "locked"
    assert last(rows[rows.seed > 1]) == "locked"


def test_null_is_not_the_empty_text_in_a_fingerprint(spark):
    def of(rows):
        return tuple(files.fingerprint(spark.createDataFrame(rows, "a string, b string")).first())

    assert len({of([(None, "x")]), of([("", "x")]), of([("a|b", "")]), of([("a", "b|")]), of([("-", "x")])}) == 5


def test_null_group_is_not_a_text(spark):
    rows = spark.createDataFrame([("r", 1, 0.5, None), ("r", 0, 0.5, "<null>"), ("r", 0, 0.5, "")], "run_name string, label int, probability double, g string")
    counts = metrics.subgroup_counts(rows, ["run_name"], ["g"]).withColumn("value", metrics.group_value())
    assert sorted((str(r["value"]) for r in counts.select("value").distinct().collect())) == ["", "<null>", "None"]


def test_empty_patch_is_wholly_black(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0), (1, 99, 99, 99)], "p int, b08 int, b13 int, b15 int")
    patches = spark.createDataFrame([(1,), (2,)], "p int")
    assert {r["p"]: r["black_fraction"] for r in raster.black_fraction(pixels, ["p"], patches=patches).collect()} == {1: 0.5, 2: 1.0}
    assert raster.valid_coverage(pixels, ["p"], patches=patches).count() == 0


def test_min_distance_equals_all_pairs(spark):
    import random
    from math import asin, cos, radians, sin, sqrt

    draw = random.Random(5)
    at = datetime(2024, 1, 1)
    events = [(at + timedelta(seconds=draw.randrange(900)), 3 + draw.random() / 2, 101 + draw.random() / 2) for _ in range(40)]
    asked = [(i, at, 2.5 + draw.random() * 1.5, 100.5 + draw.random() * 1.5) for i in range(150)]

    def km(a, b, c, d):
        h = sin(radians(a - c) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(b - d) / 2) ** 2
        return 2 * geo.RADIUS_KM_V1 * asin(sqrt(h))

    want = {i for i, t, la, lo in asked if all(not (t <= e[0] < t + timedelta(minutes=10)) or km(la, lo, e[1], e[2]) >= 30 for e in events)}
    got = joins.min_distance_filter(
        spark.createDataFrame(asked, "id int, frame_time timestamp, lat double, lon double"),
        spark.createDataFrame(events, "ts timestamp, lat double, lon double"), 0, 10, 30.0)
    assert {r["id"] for r in got.select("id").collect()} == want and 0 < len(want) < 150


def test_versioned_write_counts_what_it_wrote(spark, tmp_path):
    path = files.write_versioned(spark.range(10).withColumn("g", F.col("id") % 2), str(tmp_path), "v1", "g")
    assert spark.read.parquet(path).count() == 10
