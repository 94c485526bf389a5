import json
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.operators import planning
from skyledger.session import scratch_path
from skyledger.sources import files
from skyledger.streaming import ingest
from tests.test_joins import BASE, at, strikes


def test_header_drift_and_malformed_files(spark, tmp_path):
    good = tmp_path / "2024" / "west" / "01 JAN" / "15"
    swapped = tmp_path / "2024" / "west" / "01 JAN" / "16"
    bad = tmp_path / "2024" / "west" / "01 JAN" / "17"
    for d in (good, swapped, bad):
        os.makedirs(d)
    name = "raw data all.csv"
    (good / name).write_text(
        "Date/Time,Latitude,Longitude,Amplitude,Cloud or Ground\n2024-01-15 00:09:46Z,3.0,101.0,-5,Ground\n"
        "2024-01-15 00:10:00Z,3.0,101.0,5,Cloud\n2024-01-15 01:00:00Z,40.0,101.0,5,Ground\n"
    )
    (swapped / name).write_text(
        "Longitude,Latitude,Cloud or Ground,Date/Time,Amplitude\n102.0,4.0,GROUND,2024-01-16 00:00:01Z,1\n103.0,x,Ground,never,1\n"
    )
    (bad / name).write_text("Date/Time,Latitude\n2024-01-17 00:00:00Z,3.0\n")
    raw = files.scan_strikes(spark, str(tmp_path))
    kept = files.normalize_strikes(raw, 99.0, -5.0, 120.0, 15.0).orderBy("ts").collect()
    assert [(r.lat, r.lon) for r in kept] == [(3.0, 101.0), (4.0, 102.0)]
    inventory = {r.source_file.split("/")[-2]: r for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert inventory["15"].status == "valid" and inventory["15"].row_count == 3 and inventory["15"].ground_event_count == 2
    assert inventory["16"].invalid_timestamp_count == 1 and len(inventory["16"].sha256) == 64
    assert inventory["17"].status == "invalid" and "Longitude" in inventory["17"].error
    parts = raw.select(*[c.alias(n) for n, c in files.path_parts(F.col("source_file")).items()]).distinct().collect()
    assert {r.month for r in parts} == {"01 JAN"}
    assert {r.day for r in parts} == {"15", "16"} and {r.year for r in parts} == {"2024"}


def test_fingerprint_ignores_order_only(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("a"))
    assert files.fingerprint(df).first() == files.fingerprint(df.orderBy(F.desc("a"))).first()
    assert files.fingerprint(df).first() != files.fingerprint(df.where("a <> '3'")).first()


def test_versions_are_immutable(spark):
    root = scratch_path(spark, "v")
    files.write_versioned(spark.range(3).withColumn("split", F.lit("a")), root, "v1", "split")
    with pytest.raises(Exception):
        files.write_versioned(spark.range(3).withColumn("split", F.lit("a")), root, "v1", "split")


def write(spark, path, rows):
    strikes(spark, rows).coalesce(1).write.mode("append").parquet(path)


def test_stream_bins_drop_late_rows_and_close_windows(spark):
    src, out, cp = (scratch_path(spark, n) for n in ("src", "out", "cp"))
    schema = strikes(spark, [(0, 1.0, 100.0)]).schema
    write(spark, src, [(0, 1.0, 100.0), (5, 2.0, 100.0), (100, 1.0, 100.0)])
    ingest.run_to_table(ingest.bins(ingest.strike_stream(spark, src, schema)), out, cp)
    write(spark, src, [(6, 9.0, 100.0), (101, 2.0, 100.0), (200, 1.0, 100.0)])  # minute 6 is too late
    got = ingest.run_to_table(ingest.bins(ingest.strike_stream(spark, src, schema)), out, cp).orderBy("frame_time").collect()
    assert [(r.frame_time, r.strike_count, r.centroid_lat) for r in got] == [(at(0), 2, 1.5), (at(100), 2, 1.5)]


def test_stream_ledger_restarts(spark):
    src, ledger, cp = (scratch_path(spark, n) for n in ("src", "led", "cp"))
    schema = strikes(spark, [(0, 1.0, 100.0)]).schema
    write(spark, src, [(0, 1.0, 100.0), (5, 2.0, 100.0), (20, 1.0, 100.0)])

    def run():
        from skyledger.functions import timegrid

        rows = ingest.strike_stream(spark, src, schema).select(timegrid.floor_slot(F.col("ts")).alias("frame_time"))
        return sorted(r.frame_time for r in ingest.append_new_frames(rows, ledger, cp).collect())

    assert run() == [at(0), at(20)]
    write(spark, src, [(7, 1.0, 100.0), (40, 1.0, 100.0)])
    assert run() == [at(0), at(20), at(40)]
    assert run() == [at(0), at(20), at(40)]


def test_a_batch_reads_its_own_days_of_the_ledger(spark):
    ledger = scratch_path(spark, "led")
    assert ingest.known_frames(spark, ledger, 3, [BASE.date()]).count() == 0
    rows = spark.range(300).select((F.lit(BASE) + F.make_dt_interval(days=F.col("id"))).alias("frame_time"))
    old = rows.withColumns({"day": F.to_date("frame_time"), "batch": (F.col("frame_time") == F.lit(BASE)).cast("bigint")})
    old.coalesce(1).write.partitionBy("day", "batch").parquet(ledger)
    days = [(BASE + timedelta(days=d)).date() for d in (0, 7, 299)]
    assert ingest.known_frames(spark, ledger, 3, days).count() == 3
    assert ingest.known_frames(spark, ledger, 1, days).count() == 2  # a replay ignores its own rows
    scan = ingest.known_frames(spark, ledger, 3, days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "day#" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_dedup_and_join(spark):
    src = scratch_path(spark, "src")
    schema = strikes(spark, [(0, 1.0, 100.0)]).schema
    write(spark, src, [(0, 1.0, 100.0), (0, 1.0, 100.0), (12, 2.0, 100.0)])
    rows = ingest.strike_stream(spark, src, schema)
    out = ingest.run_to_table(ingest.dedup(rows), scratch_path(spark, "o"), scratch_path(spark, "c"))
    assert out.count() == 2
    frames = rows.where("lat = 2.0").select((F.col("ts") - F.expr("interval 2 minutes")).alias("frame_time"))
    pairs = ingest.run_to_table(
        ingest.label_join(frames, ingest.strike_stream(spark, src, schema)), scratch_path(spark, "o"), scratch_path(spark, "c")
    )
    assert [r.ts for r in pairs.collect()] == [at(12)]


def test_a_broken_publication_leaves_the_published_version(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        files.current(spark, root)
    good = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("split"))
    checks = {"partition_by": ["split"], "keys": ["id"], "required": ["split"]}
    files.publish(good, root, "v1", **checks)

    torn = good.withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("disk gone")).cast("bigint")).otherwise(F.col("id")))
    for rows, error in (
        (torn, Exception), (good.union(good.limit(1)), ValueError), (good.where("false"), ValueError),
        (good.withColumn("split", F.when(F.col("id") != 5, F.col("split"))), ValueError), (good.drop("id"), ValueError),
    ):
        with pytest.raises(error):
            files.publish(rows, root, "v2", **({**checks, "partition_by": []}))
        assert files.current(spark, root).count() == 100
    with pytest.raises(ValueError, match="already"):
        files.publish(good, root, "v1", **checks)

    files.publish(good.where("id < 10"), root, "v2", **checks)  # the remains of broken attempts are not in its way
    assert files.current(spark, root).count() == 10
    log = files.versions(spark, root).orderBy("sequence").collect()
    assert [(r.sequence, r.version, r.rows) for r in log] == [(1, "v1", 100), (2, "v2", 10)]
    assert spark.read.parquet(log[0].path).count() == 100


def test_resumed_manifest_drops_stale_rows(spark):
    kinds = "frame_id string, split string, window_start int, window_end int"
    planned = spark.createDataFrame([(f, "train", 0, 10) for f in "abcd"], kinds)
    row = kinds + ", bands string, segments string, path string"
    done = spark.createDataFrame([
        ("a", "train", 0, 10, "B", "S", "a1"), ("a", "train", 0, 10, "B", "S", "a2"), ("b", "train", 0, 10, "B", "S", "b1"),
        ("b", "train", 0, 10, "B", "S", None), ("c", "val", 0, 10, "B", "S", "c1"), ("z", "train", 0, 10, "B", "S", "z1"),
    ], row)
    redone = spark.createDataFrame([(f, "train", 0, 10, "B", "S", f"{f}9") for f in "abcdz"], row)
    got = planning.resumed_manifest(planned, done, redone, "B", "S").collect()
    assert sorted((r.path, r.kept) for r in got) == [("a1", True), ("a2", True), ("b9", False), ("c9", False), ("d9", False)]
    assert planning.pending_frames(planned, done.where("false"), "B", "S").count() == 4


def test_label_join_partitions_follow_the_pairs(spark, tmp_path, monkeypatch):
    frames = spark.createDataFrame([(f"c{i}", at(10 * (i % 20))) for i in range(100)], "candidate_id string, frame_time timestamp")
    strikes = spark.createDataFrame([(f"s{i}", at(i % 300)) for i in range(600)], "solution_key string, ts timestamp")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ingest.label_join_partitions(frames, strikes) == least
    assert ingest.label_join_partitions(frames.where("false"), strikes) == least
    monkeypatch.setattr(ingest, "PAIRS", 2000 // (least + 3))
    # 20 slots with 5 frames and 20 strikes each
    assert ingest.label_join_partitions(frames, strikes) == least + 4
    monkeypatch.setattr(ingest, "PAIRS", 1)
    assert ingest.label_join_partitions(frames, strikes) == 20

    frames.write.parquet(f"{tmp_path}/frames")
    strikes.write.parquet(f"{tmp_path}/strikes")
    joined = ingest.label_join(*[spark.readStream.schema(t.schema).parquet(f"{tmp_path}/{n}") for t, n in ((frames, "frames"), (strikes, "strikes"))])
    got = ingest.run_to_table(joined, f"{tmp_path}/out", f"{tmp_path}/cp", least + 3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == str(least)
    kept = json.loads((tmp_path / "cp" / "offsets" / "0").read_text().splitlines()[1])["conf"]
    assert kept["spark.sql.shuffle.partitions"] == str(least + 3)
    assert got.count() == 100 * 20
