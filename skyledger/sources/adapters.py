"""Strikes, predictions, runs and patches derived from the benchmark tables.

Only integer arithmetic and md5 are used, so any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.hashing import uniform

TRAIN_END, VAL_END = "2024-01-21 23:59:59", "2024-01-25 23:59:59"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table, in the splits its files have."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_strikes(table(spark, sf_dir, "events"))


def shape_strikes(events: DataFrame) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    return events.select(
        event.cast("string").alias("solution_key"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(1.2) + ((user * 53 + event * 29) % 560) / F.lit(100.0)).alias("lat"),
        (F.lit(99.7) + ((user * 37 + event * 13) % 470) / F.lit(100.0)).alias("lon"),
        ((F.col("value") - 50.0) / 5.0).alias("amplitude"),
        F.when(F.col("event_type").isin("click", "view"), "Ground").otherwise("Cloud").alias("kind"),
        F.concat(F.lit("f"), (user % 10).cast("string")).alias("source_file"),
        "event_type",
    )


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strikes(spark, sf_dir).where(F.col("kind") == "Ground")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch centres to test, one per ``error`` event."""
    from skyledger.functions.timegrid import floor_slot

    return strikes(spark, sf_dir).where(F.col("event_type") == "error").select(
        F.col("solution_key").alias("candidate_id"), floor_slot(F.col("ts")).alias("frame_time"), "lat", "lon"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws(
        "_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.date_format("l_shipdate", "yyyyMMdd"),
    )
    base = table(spark, sf_dir, "lineitem").select(
        path.alias("path"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_linestatus").alias("run_name"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_suppkey").alias("storm_id"),
        F.when(F.col("l_quantity") > 25, "active").otherwise("zero_recorded").alias("frame_category"),
        uniform("s", "l_orderkey").alias("_s"),
    )
    p = F.floor(F.lit(1000.0) * (F.lit(0.6) * uniform("p", "path") + F.lit(0.4) * F.col("label"))) / F.lit(1000.0)
    clipped = F.least(F.greatest(F.col("probability"), F.lit(0.001)), F.lit(0.999))
    return (
        base.withColumn("probability", p)
        .withColumn("logit", F.ln(clipped / (F.lit(1.0) - clipped)))
        .withColumn("split", F.when(F.col("_s") < 0.7, "train").when(F.col("_s") < 0.85, "val").otherwise("test"))
        .drop("_s")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training record per order."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("run_id"),
        F.col("o_orderstatus").alias("architecture"),
        (F.col("o_custkey") % 3).alias("seed"),
        F.col("o_orderpriority").alias("loss_name"),
        F.when(F.col("o_custkey") % 2 == 0, "none").otherwise("right_angle").alias("augmentation"),
        (F.floor(uniform("pr", "o_orderkey") * 1000) / 1000.0).alias("validation_pr_auc"),
        (F.floor(uniform("ls", "o_orderkey") * 1000) / 1000.0).alias("validation_loss"),
        (F.floor(uniform("ro", "o_orderkey") * 1000) / 1000.0).alias("validation_roc_auc"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training curves: one run per customer, one epoch per order in order-key order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("step"),
        (F.floor(uniform("hp", "o_orderkey") * 100) / 100.0).alias("pr_auc"),
        (F.floor(uniform("hl", "o_orderkey") * 100) / 100.0).alias("loss"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 single-band patches in kelvin, one per embedding."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("patch_id"),
        F.col("label").alias("class_id"),
        F.transform("embedding", lambda x: F.lit(255.0) + F.lit(60.0) * x.cast("double")).alias("kelvin"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long pixel rows of three bytes-valued bands; every third frame has a dark strip."""
    rows = patches(spark, sf_dir).select("patch_id", "class_id", F.posexplode("kelvin").alias("pos", "kelvin"))
    x, y = F.col("pos") % 8, F.floor(F.col("pos") / 8).cast("int")
    dark = (F.col("patch_id") % 3 == 0) & (x < 2)
    byte = F.least(F.greatest(F.rint((F.col("kelvin") - 200.0) / 110.0 * 255.0), F.lit(0.0)), F.lit(255.0)).cast("int")

    def band(mult: int, add: int):
        return F.when(dark, 0).otherwise((byte * mult + x * add + y * (add + 3)) % 256).cast("int")

    return rows.select(
        F.col("patch_id").alias("frame_id"), F.col("class_id"), x.cast("int").alias("x"), y.alias("y"), "kelvin",
        band(1, 17).alias("b08"), band(3, 13).alias("b13"), band(5, 11).alias("b15"),
    )


#: Size of a frame's image, and kelvin below which its pixels are black.
WIDTH, HEIGHT, BLACK_BELOW = 235, 280, 240.0


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One satellite image per embedding: its number, how many there are, and its 8x8 blocks in kelvin.

    Images of odd number and class 9 could not be read.
    """
    from skyledger.operators.ranking import global_rank

    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", (~((F.col("label") == 9) & (F.col("vec_id") % 2 == 1))).alias("readable"),
        F.transform("embedding", lambda v: F.lit(255.0) + F.lit(60.0) * v.cast("double")).alias("kelvin"),
    )
    return global_rank(rows, [], ["vec_id"], "_k").withColumn("image_id", F.col("_k") - 1).drop("_k", "vec_id")


def black_pixels(images: DataFrame) -> DataFrame:
    """(image_id, x, y, b08, b13, b15): the pixel rows of images that are black in every band."""
    blocks = images.select("image_id", F.posexplode("kelvin").alias("pos", "kelvin")).where(F.col("kelvin") < BLACK_BELOW)

    def span(at, size: int):
        return F.explode(F.sequence(F.ceil(at * size / 8).cast("int"), F.ceil((at + 1) * size / 8).cast("int") - 1))

    columns = blocks.withColumn("x", span(F.col("pos") % 8, WIDTH))
    rows = columns.withColumn("y", span(F.floor(F.col("pos") / 8), HEIGHT))
    return rows.select("image_id", "x", "y", *[F.lit(0).alias(b) for b in ("b08", "b13", "b15")])


def raw_tree(spark: SparkSession, sf_dir: str) -> str:
    """Write the events as a tree ``year/region/month/day`` of CSV files with differing headers.

    ``east`` files have reordered columns and no key, ``broken`` files lack a required column,
    and rows of ``signup`` events carry an unreadable time.
    """
    from skyledger.session import scratch_path

    root = scratch_path(spark, "raw")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z"))
    user = F.col("source_user")
    rows = strikes(spark, sf_dir).withColumn(
        "source_user", F.regexp_extract("source_file", "([0-9])", 1).cast("int")
    ).select(
        F.when(F.col("event_type") == "signup", "unknown").otherwise(stamp).alias("Date/Time"),
        F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), F.col("amplitude").alias("Amplitude"),
        F.col("kind").alias("Cloud or Ground"), F.col("solution_key").alias("Solution Key"),
        F.when(user < 2, "east").when(user < 3, "broken").otherwise("peninsula").alias("region"),
        F.date_format("ts", "yyyy").alias("year"), F.date_format("ts", "MM").alias("month"),
        F.date_format("ts", "dd").alias("day"),
    ).repartition("year", "region", "month", "day")
    parts = ["year", "region", "month", "day"]
    columns = {
        "peninsula": ["Date/Time", "Latitude", "Longitude", "Amplitude", "Cloud or Ground", "Solution Key"],
        "east": ["Longitude", "Latitude", "Cloud or Ground", "Date/Time", "Amplitude"],
        "broken": ["Date/Time", "Latitude", "Longitude", "Amplitude"],
    }
    for region, names in columns.items():
        rows.where(F.col("region") == region).select(*names, *parts).write.mode("append").partitionBy(*parts).option(
            "header", True
        ).csv(root)
    return root


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled patch manifest: ground strikes positive, cloud strikes negative.

    A few rows carry a wrong split and several share a content hash, so audits find something.
    """
    from skyledger.functions import geo, timegrid

    slot = timegrid.floor_slot(F.col("ts"))
    x, y = geo.to_pixel(F.col("lat"), F.col("lon"))
    t = F.col("frame_time")
    rows = strikes(spark, sf_dir).withColumns({"frame_time": slot, "x": x, "y": y})
    stamp = F.date_format(t, "yyyyMMdd_HHmm")
    return rows.select(
        F.concat(F.lit("p"), "solution_key").alias("path"), (F.col("kind") == "Ground").cast("int").alias("label"),
        "ts", "frame_time", F.concat(F.lit("H09_"), stamp).alias("frame_id"), F.date_format(t, "yyyy-MM-dd").alias("date"),
        F.concat_ws("_", "source_file", F.date_format(t, "yyyyMMdd")).alias("storm_id"),
        F.concat(F.lit("hsd_"), F.date_format(t, "yyyyMMdd_HH"), F.lit(";aux_"), "source_file").alias("source_files"),
        F.when(uniform("fc", stamp) < 0.6, "active").otherwise("zero_recorded").alias("frame_category"),
        F.when(uniform("nz", "solution_key") < 0.002, "test").otherwise(
            timegrid.split_by_instant(t, TRAIN_END, VAL_END)
        ).alias("split"),
        "lat", "lon", "amplitude", "x", "y", (F.col("x") - 32).alias("x0"), (F.col("y") - 32).alias("y0"),
        (F.col("x") + 32).alias("x1"), (F.col("y") + 32).alias("y1"),
        geo.grid_label(F.col("lat"), F.col("lon")).alias("grid_cell"),
        geo.boundary_distance_km(F.col("lat"), F.col("lon")).alias("boundary_km"),
        timegrid.local_hour(t).alias("local_hour"), F.month(t).alias("month"),
        F.md5(F.concat_ws("|", F.lit("sha"), F.floor(F.col("x") / 3).cast("string"), F.floor(F.col("y") / 3).cast("string")).cast("binary")).alias("sha256"),
    )
