"""Reading and inventorying trees of event CSV files; versioned writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyledger.session import cut

REQUIRED = ("Date/Time", "Latitude", "Longitude", "Cloud or Ground")


def _tree(spark: SparkSession, fmt: str, root: str, glob: str):
    return spark.read.format(fmt).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def _lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return lines.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def file_headers(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """First line of every file that has one, whatever it says."""
    # rows of a block come in file order, so the smallest row number of the first block is line one
    first = _lines(spark, root, glob).where("_block = 0").withColumn("_row", F.monotonically_increasing_id())
    return first.groupBy("source_file").agg(F.min_by("value", "_row").alias("header"))


def header_names(header: Column) -> Column:
    return F.transform(F.split(header, ","), lambda n: F.trim(F.regexp_replace(n, '^"|"$|^\ufeff', "")))


def missing_columns(header: Column, required=REQUIRED) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(c) for c in required]), header_names(header)))


def scan_strikes(spark: SparkSession, root: str, glob: str = "raw data all.csv", required=REQUIRED) -> DataFrame:
    """All rows of the readable files as strings, plus ``source_file``.

    Each line meets its own file's header in a join, and its fields are named by position, so a
    reordered or extended header never shifts columns; files lacking a required column are
    left out. The driver only sees the distinct column names. A line equal to the header is a
    row, too, except the first one.
    """
    headers = file_headers(spark, root, glob).where(F.size(missing_columns(F.col("header"), required)) == 0)
    headers = cut(headers.withColumn("_names", header_names(F.col("header"))))
    names = [r[0] for r in headers.select(F.explode("_names").alias("n")).distinct().orderBy("n").collect()]
    if not names:
        raise FileNotFoundError(f"no readable event files below {root}")
    width = headers.agg(F.max(F.size("_names"))).first()[0]
    joined = _lines(spark, root, glob).where("value <> ''").join(headers, "source_file")
    again = joined.where("value = header").groupBy("source_file", "value", "_names").agg(F.count(F.lit(1)).alias("_n"))
    again = again.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), (F.col("_n") - 1).cast("int"))))
    body = joined.where("value <> header").select("source_file", "value", "_names").unionByName(again.select("source_file", "value", "_names"))
    schema = ", ".join(f"c{i} string" for i in range(width))
    fields = F.array(*[F.col(f"_f.c{i}") for i in range(width)])
    named = body.select("source_file", "_names", F.from_csv("value", schema).alias("_f")).select("source_file", "_names", fields.alias("_v"))
    # of two columns of one name the first counts
    return named.select(
        *[F.when(F.array_position("_names", n) > 0, F.get("_v", (F.array_position("_names", n) - 1).cast("int"))).alias(n) for n in names],
        "source_file",
    )


def coerce_strikes(raw: DataFrame) -> DataFrame:
    """Typed columns; unparsable values become null."""
    return raw.select(
        F.col("Date/Time").try_cast("timestamp").alias("ts"),
        F.col("Latitude").try_cast("double").alias("lat"),
        F.col("Longitude").try_cast("double").alias("lon"),
        (F.col("Amplitude").try_cast("double") if "Amplitude" in raw.columns else F.lit(None).cast("double"))
        .alias("amplitude"),
        F.col("Cloud or Ground").alias("kind"),
        (F.col("Solution Key") if "Solution Key" in raw.columns else F.lit("")).alias("solution_key"),
        *[c for c in ("source_file",) if c in raw.columns],
    )


def normalize_strikes(raw: DataFrame, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> DataFrame:
    """Ground strokes with usable time and place inside an inclusive box."""
    return (
        coerce_strikes(raw)
        .where(F.lower(F.trim("kind")) == "ground")
        .dropna(subset=["ts", "lat", "lon"])
        .where(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max))
    )


def file_inventory(spark: SparkSession, root: str, glob: str = "raw data all.csv") -> DataFrame:
    """One row per file: identity, status, coverage and counts."""
    files = _tree(spark, "binaryFile", root, glob).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    missing = missing_columns(F.coalesce(F.col("header"), F.lit("")))
    described = files.join(file_headers(spark, root, glob), "source_file", "left").select(
        "source_file", "size_bytes", "sha256",
        F.when(F.size(missing) == 0, "valid").otherwise("invalid").alias("status"),
        F.when(F.size(missing) == 0, "").otherwise(
            F.concat(F.lit("missing required columns: "), F.array_join(missing, ","))
        ).alias("error"),
    )
    rows = coerce_strikes(scan_strikes(spark, root, glob))
    is_ground = F.lower(F.trim("kind")) == "ground"
    counts = rows.groupBy("source_file").agg(
        F.array_sort(F.collect_set(F.to_date("ts"))).alias("dates"),
        F.count(F.lit(1)).alias("row_count"),
        F.min("ts").alias("timestamp_min_utc"), F.max("ts").alias("timestamp_max_utc"),
        F.count_if(F.col("ts").isNull()).alias("invalid_timestamp_count"),
        F.count_if(is_ground & F.col("ts").isNotNull()).alias("ground_event_count"),
    )
    zero = ("row_count", "invalid_timestamp_count", "ground_event_count")
    return described.join(counts, "source_file", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in zero}
    )


def load_valid_strikes(raw: DataFrame, inventory: DataFrame, mask) -> DataFrame:
    """Ground strikes inside the mask, from inventoried valid files only."""
    valid = inventory.where(F.col("status") == "valid").select("source_file")
    rows = coerce_strikes(raw).where(F.lower(F.trim("kind")) == "ground").where(
        F.col("ts").isNotNull() & mask.contains(F.col("lat"), F.col("lon"))
    )
    return rows.join(valid, "source_file", "left_semi").select("ts", "lat", "lon", "solution_key", "source_file")


def path_parts(path: Column) -> dict[str, Column]:
    """Year, month and day from the third- to fifth-last path segments."""
    parts = F.split(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/")

    def segment(position: int) -> Column:
        return F.element_at(F.split(F.element_at(parts, position), "="), -1)

    return {"year": segment(-5), "month": segment(-3), "day": segment(-2)}


def write_versioned(df: DataFrame, root: str, version: str, *partition_by: str) -> str:
    """Write an immutable version of a table; the rows read back must be as many as were written."""
    path = f"{root.rstrip('/')}/{version}"
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if found != written.get["rows"]:
        raise OSError(f"{path} holds {found} rows of {written.get['rows']}")
    return path


_LOG = "sequence bigint, version string, path string, rows bigint"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The published versions of a table, oldest first by ``sequence``; no rows where there is none yet."""
    try:
        return spark.read.schema(_LOG).parquet(f"{root.rstrip('/')}/_published")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the version published last."""
    last = versions(spark, root).orderBy(F.desc("sequence")).first()
    if last is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(last["path"])


def faults(df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> dict[str, int]:
    """Rows that break a rule: nulls in required columns (the keys included) and rows beyond one a key."""
    needed = list(dict.fromkeys([*keys, *required]))
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    nulls = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in needed])
    out = nulls.first().asDict()
    if keys:
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        out["repeated"] = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).first()["n"]
    return out


def publish(
    df: DataFrame, root: str, version: str, partition_by: Sequence[str] = (), keys: Sequence[str] = (), required: Sequence[str] = ()
) -> str:
    """Write a new version, check the rows that are on disk, and only then make it the current one.

    The rows go to a folder of this attempt; a write or a check that fails leaves the published
    versions as they were, and a later attempt does not meet its remains. Publishing appends one row
    to the log, which Spark commits as one file. Old versions stay readable. A table without rows is
    refused. One writer at a time publishes to a root.
    """
    spark, log = df.sparkSession, f"{root.rstrip('/')}/_published"
    known = versions(spark, root)
    if known.where(F.col("version") == version).limit(1).count():
        raise ValueError(f"version {version} is already published")
    path = write_versioned(df, root, f"{version}-{uuid.uuid4().hex[:12]}", *partition_by)
    found = faults(spark.read.schema(df.schema).parquet(path), keys, required)
    rows = found.pop("rows")
    broken = {k: n for k, n in found.items() if n}
    if broken or not rows:
        raise ValueError(f"version {version} is not published: {broken or 'no rows'}")
    number = known.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("n")).first()["n"] + 1
    spark.createDataFrame([(number, version, path, rows)], _LOG).coalesce(1).write.mode("append").parquet(log)
    return path


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content hash: row count and summed 60-bit md5 heads of the rows.

    ``df`` must hold values whose text form is exact (strings, integers, rounded numbers). Each
    value goes in with its length, and null as a sign of its own, so no two rows read alike.
    """
    text = [F.col(c).cast("string") for c in sorted(df.columns)]
    cols = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    digest = F.md5(F.concat_ws("|", *cols).cast("binary"))
    head = F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")
    tail = F.conv(F.substring(digest, 13, 12), 16, 10).cast("bigint")
    modulus = F.lit(281474976710597)
    return df.select(head.alias("h"), tail.alias("t")).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum(F.col("h").cast("decimal(38,0)")) % modulus).cast("bigint").alias("hash_a"),
        (F.sum(F.col("t").cast("decimal(38,0)")) % modulus).cast("bigint").alias("hash_b"),
    )


def write_csv_runs(predictions: DataFrame, root: str) -> str:
    predictions.write.mode("errorifexists").partitionBy("run_name").option("header", True).csv(root)
    return root


def scan_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Prediction files of all runs; the run comes from the path, its threshold from the file."""
    rows = (
        spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        .schema("path string, label int, probability double, threshold double").csv(root)
        .withColumn("run_name", F.regexp_extract("_metadata.file_path", "run_name=([^/]+)", 1))
    )
    threshold = rows.groupBy("run_name").agg(F.min("threshold").alias("threshold"))
    # one row per run: the predictions stay where they are read
    return rows.drop("threshold").join(F.broadcast(threshold), "run_name")


def write_json_ledger(ledger: DataFrame, root: str, metadata: dict[str, str]) -> DataFrame:
    """Records as JSON lines plus a one-row metadata document; returns the metadata read back."""
    spark = ledger.sparkSession
    ledger.write.mode("errorifexists").json(f"{root}/records")
    records = spark.read.json(f"{root}/records")
    summary = records.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    meta = summary.agg(
        F.sum("n").alias("records"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories")
    ).withColumns({k: F.lit(v) for k, v in metadata.items()})
    meta.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(f"{root}/metadata")
    return spark.read.text(f"{root}/metadata")
