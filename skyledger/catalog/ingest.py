"""Scans, inventories and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import query, sql_with
from skyledger.functions import geo
from skyledger.functions.scores import sigmoid
from skyledger.operators import planning
from skyledger.session import scratch_path
from skyledger.sources import adapters as A
from skyledger.sources import files

RAW = """raw as (select *, substr(source_file, 2, 1)::int as su, case when substr(source_file, 2, 1)::int < 2 then 'east'
  when substr(source_file, 2, 1)::int < 3 then 'broken' else 'peninsula' end as region,
  strftime(ts, '%Y') as year, strftime(ts, '%m') as month, strftime(ts, '%d') as day,
  case when event_type = 'signup' then null else ts end as good_ts from strikes)"""
GLOB = "*.csv"


def _region(path):
    return F.regexp_extract(path, "region=([^/]+)", 1)


@query("scan_strikes", sql_with("strikes", f"""+{RAW}
select region, year, month, day, case when event_type = 'signup' then 'unknown' else strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || 'Z' end as stamp,
  lat, lon, amplitude, kind, case when region = 'east' then null else solution_key end as solution_key
  from raw where region <> 'broken'"""))
def scan_strikes(spark, sf):
    rows = files.scan_strikes(spark, A.raw_tree(spark, sf), GLOB)
    return rows.select(
        _region("source_file").alias("region"),
        *[c.alias(n) for n, c in files.path_parts(F.col("source_file")).items()],
        F.col("Date/Time").alias("stamp"), F.col("Latitude").cast("double").alias("lat"),
        F.col("Longitude").cast("double").alias("lon"), F.col("Amplitude").cast("double").alias("amplitude"),
        F.col("Cloud or Ground").alias("kind"), F.col("Solution Key").alias("solution_key"),
    )


@query("normalize_strikes", sql_with("strikes", f"""+{RAW}
select solution_key, ts, lat, lon, amplitude from raw where event_type <> 'signup' and kind = 'Ground'
  and lat between 2.0::double and 6.0::double and lon between 100.0::double and 104.0::double"""))
def normalize_strikes(spark, sf):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z"))
    raw = A.strikes(spark, sf).select(
        F.when(F.col("event_type") == "signup", "unknown").otherwise(stamp).alias("Date/Time"),
        F.col("lat").cast("string").alias("Latitude"), F.col("lon").cast("string").alias("Longitude"),
        F.col("amplitude").cast("string").alias("Amplitude"),
        F.upper("kind").alias("Cloud or Ground"), F.col("solution_key").alias("Solution Key"),
    )
    return files.normalize_strikes(raw, 100.0, 2.0, 104.0, 6.0).select("solution_key", "ts", "lat", "lon", "amplitude")


@query("load_valid_strikes", sql_with("strikes", f"""+{RAW}
select region, day, ts, lat, lon, case when region = 'east' then '' else solution_key end as solution_key from raw
  where region <> 'broken' and kind = 'Ground' and good_ts is not null"""))
def load_valid_strikes(spark, sf):
    root = A.raw_tree(spark, sf)
    rows = files.load_valid_strikes(
        files.scan_strikes(spark, root, GLOB), files.file_inventory(spark, root, GLOB), geo.MASK
    )
    return rows.select(
        _region("source_file").alias("region"), files.path_parts(F.col("source_file"))["day"].alias("day"),
        "ts", "lat", "lon", F.coalesce("solution_key", F.lit("")).alias("solution_key"),
    )


@query("path_partitions", sql_with("strikes", f"""+{RAW}
select region, year, month, day, count(*) as rows from raw where region <> 'broken' group by all"""))
def path_partitions(spark, sf):
    rows = files.scan_strikes(spark, A.raw_tree(spark, sf), GLOB)
    parts = [c.alias(n) for n, c in files.path_parts(F.col("source_file")).items()]
    return rows.groupBy(_region("source_file").alias("region"), *parts).agg(F.count(F.lit(1)).alias("rows"))


@query("file_inventory", sql_with("strikes", f"""+{RAW}
select region, day, case when region = 'broken' then 'invalid' else 'valid' end as status,
  case when region = 'broken' then 'missing required columns: Cloud or Ground' else '' end as error,
  case when region = 'broken' or count(good_ts) = 0 then '' else strftime(min(good_ts), '%Y-%m-%d') end as dates,
  case when region = 'broken' then 0 else count(*) end as row_count,
  case when region = 'broken' then null else min(good_ts) end as timestamp_min_utc,
  case when region = 'broken' then null else max(good_ts) end as timestamp_max_utc,
  case when region = 'broken' then 0 else count(*) - count(good_ts) end as invalid_timestamp_count,
  case when region = 'broken' then 0 else count(case when kind = 'Ground' then good_ts end) end as ground_event_count,
  true as has_digest from raw group by region, day"""))
def file_inventory(spark, sf):
    inventory = files.file_inventory(spark, A.raw_tree(spark, sf), GLOB)
    return inventory.select(
        _region("source_file").alias("region"), files.path_parts(F.col("source_file"))["day"].alias("day"),
        "status", "error", F.coalesce(F.array_join("dates", ";"), F.lit("")).alias("dates"), "row_count",
        "timestamp_min_utc", "timestamp_max_utc", "invalid_timestamp_count", "ground_event_count",
        ((F.length("sha256") == 64) & (F.col("size_bytes") > 0)).alias("has_digest"),
    )


@query("inventory_summary", sql_with("strikes", f"""+{RAW},
f as (select region, day, count(*) as n, count(case when kind = 'Ground' then good_ts end) as g from raw group by region, day),
v as (select * from raw where region <> 'broken' and good_ts is not null),
b as (select distinct time_bucket(interval '10 minutes', ts) as slot from v where kind = 'Ground'),
d as (select count(distinct ts::date) as d from v)
select count(*) as discovered_files, count(*) filter (region <> 'broken') as valid_files,
  count(*) filter (region = 'broken') as invalid_files, (sum(n) filter (region <> 'broken'))::bigint as rows,
  (sum(g) filter (region <> 'broken'))::bigint as ground_events, (select d from d) as valid_dates,
  (select count(*) from b) as active_bins, (select 144 * d from d) - (select count(*) from b) as zero_recorded_bins from f"""))
def inventory_summary(spark, sf):
    root = A.raw_tree(spark, sf)
    inventory = files.file_inventory(spark, root, GLOB)
    calendar = planning.bin_calendar(files.coerce_strikes(files.scan_strikes(spark, root, GLOB)))
    valid = F.col("status") == "valid"
    totals = inventory.agg(
        F.count(F.lit(1)).alias("discovered_files"), F.count_if(valid).alias("valid_files"),
        F.count_if(~valid).alias("invalid_files"), F.sum("row_count").alias("rows"),
        F.sum("ground_event_count").alias("ground_events"),
    )
    bins = calendar.agg(
        F.countDistinct("date").alias("valid_dates"), F.count_if("recorded_ground_event").alias("active_bins"),
        F.count_if(~F.col("recorded_ground_event")).alias("zero_recorded_bins"),
    )
    both = totals.unionByName(bins, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("manifest_scan", sql_with("predictions", "select path, label, split from predictions where split = 'test'"))
def manifest_scan(spark, sf):
    path = files.write_versioned(
        A.predictions(spark, sf).select("path", "label", "split"), scratch_path(spark, "manifest"), "v1", "split"
    )
    return spark.read.parquet(path).where(F.col("split") == "test")


@query("prediction_scan", sql_with("predictions", """select run_name, path, label, probability,
  case run_name when 'O' then 0.55::double else 0.5::double end as threshold from predictions"""))
def prediction_scan(spark, sf):
    threshold = F.when(F.col("run_name") == "O", 0.55).otherwise(0.5)
    root = files.write_csv_runs(
        A.predictions(spark, sf).select("run_name", "path", "label", "probability", threshold.alias("threshold")),
        scratch_path(spark, "runs"),
    )
    return files.scan_predictions(spark, root)


@query("manifest_sink", sql_with("predictions", "select split, count(*) as rows from predictions group by split"))
def manifest_sink(spark, sf):
    root, rows = scratch_path(spark, "manifest"), A.predictions(spark, sf)
    checks = {"partition_by": ["split"], "keys": ["run_name", "path"], "required": ["label", "split"]}
    files.publish(rows.where("split = 'test'"), root, "v1", **checks)
    files.publish(rows, root, "v2", **checks)
    return files.current(spark, root).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("ledger_json_sink", sql_with("ledger", """select '{"records":' || count(*) || ',"categories":{"active":' || count(*) filter (category = 'active')
  || ',"zero_recorded":' || count(*) filter (category <> 'active') || '},"version":"v1"}' as "value" from ledger"""))
def ledger_json_sink(spark, sf):
    rows = A.ground(spark, sf)
    ledger = planning.candidate_ledger(planning.bin_calendar(A.strikes(spark, sf)), planning.bin_summary(rows))
    return files.write_json_ledger(ledger, scratch_path(spark, "ledger"), {"version": "v1"})


@query("prediction_sink", sql_with("scored", """select run_name, split, path, label, probability, 0.5::double as threshold,
  (probability >= 0.5::double)::int as prediction, round(1 / (1 + exp(-logit / 1.7::double)), 6) as calibrated_probability from scored"""))
def prediction_sink(spark, sf):
    rows = A.predictions(spark, sf).select(
        "run_name", "split", "path", "label", "probability", F.lit(0.5).alias("threshold"),
        (F.col("probability") >= 0.5).cast("int").alias("prediction"),
        F.round(sigmoid(F.col("logit"), 1.7), 6).alias("calibrated_probability"),
    )
    path = files.write_versioned(rows, scratch_path(spark, "predictions"), "v1", "run_name", "split")
    return spark.read.parquet(path).select(*rows.columns)


@query("table_fingerprint", sql_with("ledger", """+t as (select md5(concat_ws('|', length(category) || ':' || category, length(in_mask_count::varchar) || ':' || in_mask_count::varchar, '13:' || strftime(slot, '%Y%m%d_%H%M'))) as h from ledger)
select count(*) as rows, (sum(('0x' || substr(h, 1, 12))::bigint) % 281474976710597)::bigint as hash_a,
  (sum(('0x' || substr(h, 13, 12))::bigint) % 281474976710597)::bigint as hash_b from t"""))
def table_fingerprint(spark, sf):
    ledger = _ledger(spark, sf).select(
        "category", "in_mask_count", F.date_format("frame_time", "yyyyMMdd_HHmm").alias("slot")
    )
    return files.fingerprint(ledger)


def _ledger(spark, sf):
    calendar = planning.bin_calendar(A.strikes(spark, sf))
    return planning.candidate_ledger(calendar, planning.bin_summary(A.ground(spark, sf)))


@query("version_stamp", sql_with("ledger", """select slot as frame_time, category, 'c0ffee' as configuration_hash, 'rule-2' as label_rule_version,
  42 as random_selection_seed, 'full' as phase, case when category = 'active' then 'support and diversity'
  else 'matched to selected active frames' end as selection_reason from ledger"""))
def version_stamp(spark, sf):
    ledger = _ledger(spark, sf).select("frame_time", "category")
    return planning.version_stamp(ledger, "c0ffee", "rule-2", 42, "full")
