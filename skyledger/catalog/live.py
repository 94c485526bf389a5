"""Streaming queries over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import query, rounded, rr, sql_with
from skyledger.functions import timegrid
from skyledger.session import scratch_path
from skyledger.sources import adapters as A
from skyledger.streaming import ingest


# a pattern as the path, so that the table may be one file or a folder of files
def _strikes(spark, sf):
    schema = A.table(spark, sf, "events").schema
    raw = ingest.strike_stream(spark, f"{sf}/{{events}}.parquet", schema)
    return A.shape_strikes(raw).where("kind = 'Ground'").drop("event_type")


# a window is written once it ended 30 minutes before the newest event; the watermark counts milliseconds
@query("stream_bins", sql_with("strikes", f"""+g as (select *, time_bucket(interval '10 minutes', ts) as slot from strikes where kind = 'Ground')
select slot as frame_time, count(*) as strike_count, {rr('avg(lat)')} as centroid_lat, {rr('avg(lon)')} as centroid_lon from g group by slot
  having slot + interval '10 minutes' <= (select date_trunc('milliseconds', max(ts)) - interval '30 minutes' from g)"""))
def stream_bins(spark, sf):
    out = ingest.run_to_table(ingest.bins(_strikes(spark, sf)), scratch_path(spark, "bins"), scratch_path(spark, "cp"))
    return rounded(out, ["centroid_lat", "centroid_lon"])


@query("stream_dedup", sql_with("strikes", "select distinct solution_key, ts, lat, lon from strikes where kind = 'Ground'"))
def stream_dedup(spark, sf):
    rows = _strikes(spark, sf).select("solution_key", "ts", "lat", "lon")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = ingest.run_to_table(ingest.dedup(twice), scratch_path(spark, "dedup"), scratch_path(spark, "cp"))
    return out.select("solution_key", "ts", "lat", "lon")


@query("stream_ledger", sql_with("strikes", "select distinct time_bucket(interval '10 minutes', ts) as frame_time from strikes where kind = 'Ground'"))
def stream_ledger(spark, sf):
    frames = _strikes(spark, sf).select(timegrid.floor_slot(F.col("ts")).alias("frame_time"))
    return ingest.append_new_frames(frames, scratch_path(spark, "ledger"), scratch_path(spark, "cp"))


@query("stream_label_join", sql_with("strikes", """+f as (select solution_key as candidate_id, time_bucket(interval '10 minutes', ts) as frame_time from strikes where event_type = 'error')
select candidate_id, frame_time, s.solution_key, s.ts from f join strikes s on s.kind = 'Ground' and time_bucket(interval '10 minutes', s.ts) = frame_time"""))
def stream_label_join(spark, sf):
    def errors(rows):
        return rows.where("event_type = 'error'").select(
            F.col("solution_key").alias("candidate_id"), timegrid.floor_slot(F.col("ts")).alias("frame_time")
        )

    schema = A.table(spark, sf, "events").schema
    raw = ingest.strike_stream(spark, f"{sf}/{{events}}.parquet", schema)
    pairs = ingest.label_join(errors(A.shape_strikes(raw)), _strikes(spark, sf).select("solution_key", "ts"))
    partitions = ingest.label_join_partitions(errors(A.strikes(spark, sf)), A.ground(spark, sf))
    return ingest.run_to_table(pairs, scratch_path(spark, "pairs"), scratch_path(spark, "cp"), partitions)
