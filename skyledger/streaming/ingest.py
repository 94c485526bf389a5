"""Incremental forms of the ingest steps with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import timegrid
from skyledger.session import cut

LATENESS = "30 minutes"


def strike_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Arriving event files as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def bins(strikes: DataFrame) -> DataFrame:
    """Count and centroid of each ten-minute window; a window closes 30 minutes after its end."""
    return (
        strikes.withWatermark("ts", LATENESS).groupBy(F.window("ts", "10 minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("strike_count"), F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))
        .select(F.col("w.start").alias("frame_time"), "strike_count", "centroid_lat", "centroid_lon")
    )


def dedup(strikes: DataFrame) -> DataFrame:
    """Drop repeats of (instant, place at five decimals) that arrive within the lateness."""
    keyed = strikes.withColumns({
        "t_key": F.unix_micros("ts"), "lat5": F.bround("lat", 5), "lon5": F.bround("lon", 5),
    })
    return keyed.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["t_key", "lat5", "lon5"]).drop(
        "t_key", "lat5", "lon5"
    )


def label_join(frames: DataFrame, strikes: DataFrame) -> DataFrame:
    """Frames with the strikes of their ten minutes, as both arrive."""
    f = frames.withWatermark("frame_time", LATENESS).withColumn("slot", timegrid.slot_number(F.col("frame_time")))
    s = strikes.withWatermark("ts", LATENESS).withColumn("strike_slot", timegrid.slot_number(F.col("ts")))
    return f.join(
        s, (F.col("slot") == F.col("strike_slot")) & (F.col("ts") >= F.col("frame_time"))
        & (F.col("ts") < F.col("frame_time") + F.expr("interval 10 minutes")),
    ).drop("slot", "strike_slot")


#: Pairs that one task of a label join should write, about.
PAIRS = 1 << 21


def label_join_partitions(frames: DataFrame, strikes: DataFrame) -> int:
    """Partitions for the label join of what has arrived so far (static tables), from its pairs.

    A stream keeps its partitions, and its pairs grow faster than its rows as more events fall into
    a slot. No more partitions than slots with pairs: a slot is not split.
    """
    f = frames.groupBy(timegrid.slot_number(F.col("frame_time")).alias("slot")).agg(F.count(F.lit(1)).alias("f"))
    s = strikes.groupBy(timegrid.slot_number(F.col("ts")).alias("slot")).agg(F.count(F.lit(1)).alias("s"))
    size = f.join(s, "slot").agg(F.count(F.lit(1)).alias("slots"), F.coalesce(F.sum(F.col("f") * F.col("s")), F.lit(0)).alias("pairs")).first()
    least = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size["slots"], -(-size["pairs"] // PAIRS)))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Process everything available, exactly once, into a parquet table and read it back.

    A new stream keeps ``partitions`` (else those of the session) in its checkpoint.
    """
    spark = stream.sparkSession
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions or kept))  # a stream copies the settings as it starts
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_LEDGER = "frame_time timestamp, day date, batch bigint"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """What the ledger holds; no rows before its first batch. A ledger that is there must be readable."""
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def known_frames(spark: SparkSession, path: str, batch_id: int, days: list) -> DataFrame:
    """Frames that other batches wrote on these days; only the folders of the days are read."""
    rows = _ledger(spark, path)
    return rows.where(F.col("day").isin(days) & (F.col("batch") != batch_id)).select("frame_time", "day")


def append_new_frames(frames: DataFrame, ledger: str, checkpoint: str) -> DataFrame:
    """Append frames the ledger does not hold yet; safe to restart and to replay a batch.

    The ledger is partitioned by day and batch. A batch is compared with the days it touches (at most
    144 frames each), however long the ledger is and however late a frame arrives; a replay
    overwrites its own folders only, since the same batch has the same days.
    """
    spark = frames.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        new = cut(batch.select("frame_time", F.to_date("frame_time").alias("day")).where("frame_time is not null").distinct())
        days = [r["day"] for r in new.select("day").distinct().collect()]  # calendar days, not rows
        if not days:
            return
        fresh = new.join(known_frames(spark, ledger, batch_id, days), ["frame_time", "day"], "left_anti")
        out = fresh.withColumn("batch", F.lit(batch_id).cast("bigint")).repartition("day")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(ledger)

    query = (
        frames.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return _ledger(spark, ledger).select("frame_time")
