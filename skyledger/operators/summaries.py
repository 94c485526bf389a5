"""Aggregate summaries of ledgers, manifests and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.scores import probability_bin, ratio
from skyledger.operators.components import frame_clusters
from skyledger.operators.ranking import exact_quantiles
from skyledger.session import cut


def group_sizes(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    return df.groupBy(*keys, unit).agg(F.count(F.lit(1)).alias("size"))


def size_distribution(sizes: DataFrame, keys: Sequence[str], size: str = "size") -> DataFrame:
    """Count, quartiles, spread, maximum and mean of group sizes.

    Sizes are few distinct integers, which is what the exact percentile aggregate buffers.
    """
    q = F.percentile(size, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), q.alias("_q"), F.max(size).alias("maximum"), F.avg(size).alias("mean")
    )
    return out.select(
        *keys, "count", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"),
        (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "maximum", "mean",
    )


def class_by_split(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(F.col("label") == 1, F.col("frame_id"))).alias("positive_frames")
    )


def split_support(plan: DataFrame) -> DataFrame:
    """Per split what a frozen plan offers."""
    active = F.col("category") == "active"
    return plan.groupBy("split").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(active).alias("active_frames"),
        F.count_if(~active).alias("zero_recorded_frames"),
        F.countDistinct(F.when(active, F.col("date"))).alias("active_dates"),
        F.countDistinct(F.when(active, F.col("storm_id"))).alias("storm_groups"),
        F.sum(F.when(active, F.col("retained_positive_count")).otherwise(0)).alias("planned_positive_capacity"),
        F.count_if("cached").alias("cached_frames"), F.count_if(~F.col("cached")).alias("download_frames"),
    )


def support_blockers(support: DataFrame, min_dates: int, min_storms: int, min_capacity: int, min_frames: int) -> DataFrame:
    """A row for each minimum that validation or test misses."""
    rules = [
        ("active_dates", min_dates, "active dates below minimum"), ("storm_groups", min_storms, "storms below minimum"),
        ("planned_positive_capacity", min_capacity, f"positive capacity below {min_capacity}"),
        ("active_frames", min_frames, f"active frames below {min_frames}"),
    ]
    failed = F.array_compact(F.array(*[F.when(F.col(c) < limit, F.lit(text)) for c, limit, text in rules]))
    return support.where(F.col("split").isin("val", "test")).select(
        "split", F.explode(failed).alias("reason")
    ).select("split", F.concat_ws(" ", "split", "reason").alias("blocker"))


def cluster_dominance(manifest: DataFrame) -> DataFrame:
    """Support per split and the share of its largest frame, date and storm."""
    positive = F.col("label") == 1
    base = manifest.groupBy("split").agg(
        F.count(F.lit(1)).alias("patches"), F.count_if(positive).alias("positive"), F.count_if(~positive).alias("negative"),
        F.countDistinct("date").alias("dates"), F.countDistinct("frame_id").alias("frames"),
        F.countDistinct(F.when(positive, F.col("frame_id"))).alias("positive_frames"),
        F.countDistinct("storm_id").alias("storms"), F.countDistinct(F.when(positive, F.col("date"))).alias("active_dates"),
    )
    per_frame = size_distribution(group_sizes(manifest.where(positive), ["split"], "frame_id"), ["split"]).select(
        "split", F.col("median").alias("positive_per_frame_median"), F.col("maximum").alias("positive_per_frame_max")
    )
    out = base.join(per_frame, "split", "left")
    for unit, name in (("frame_id", "frame"), ("date", "date"), ("storm_id", "storm")):
        largest = group_sizes(manifest, ["split"], unit).groupBy("split").agg(
            (F.max("size") / F.sum("size")).alias(f"largest_{name}_fraction")
        )
        out = out.join(largest, "split")
    return out


def positive_clusters(manifest: DataFrame, eps_km: float = 20.0) -> DataFrame:
    """``(split, clusters)``: spatial clusters of the positive rows within each frame, by split and for ``all``."""
    key = F.concat_ws("|", "split", "frame_id")
    labels = frame_clusters(manifest.where("label = 1").withColumn("_frame", key), "_frame", eps_km)
    found = labels.select("frame", "component").distinct().withColumn("split", F.substring_index("frame", "|", 1))
    return found.rollup("split").agg(F.count(F.lit(1)).alias("clusters")).withColumn("split", F.coalesce("split", F.lit("all")))


def independence_report(manifest: DataFrame, clusters: DataFrame) -> DataFrame:
    """Overall and per split: how many independent frames, dates and clusters support the rows.

    ``clusters(split, clusters)`` holds the cluster counts, ``all`` for the whole. The manifest
    is reduced once to counts per (split, frame, date).
    """
    counts = cut(manifest.groupBy("split", "frame_id", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p")))
    both = counts.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("split"))))
    frames = both.groupBy("scope", "frame_id").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    base = frames.groupBy("scope").agg(
        F.sum("n").alias("patches"), F.sum("p").alias("positive_patches"), F.count("frame_id").alias("frames"),
        F.count_if((F.col("p") > 0) & F.col("frame_id").isNotNull()).alias("positive_frames"),
    )
    base = base.join(both.select("scope", "date").distinct().groupBy("scope").agg(F.count("date").alias("dates")), "scope")
    for prefix, column in (("patches", "n"), ("positives", "p")):
        sizes = frames.where(F.col(column) > 0).select("scope", F.col(column).alias("size"))
        dist = size_distribution(sizes, ["scope"]).drop("count")
        base = base.join(dist.select("scope", *[
            F.col(c).alias(f"{prefix}_per_frame_{c}") for c in dist.columns if c != "scope"
        ]), "scope", "left")
    return base.join(clusters.withColumnRenamed("split", "scope"), "scope", "left")


def coordinate_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    flat = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("coordinate"), F.col(c).alias("value")) for c in columns
    ])).alias("v")).select(*keys, "v.*")
    probs = {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    return exact_quantiles(flat, [*keys, "coordinate"], "value", probs)


def value_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of several columns, null included."""
    flat = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("v")).select("v.*")
    return flat.groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))


def prevalence_breakdown(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Samples and prevalence along each dimension."""
    flat = df.select("label", F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions
    ])).alias("v")).select("label", "v.*")
    positive = F.sum("label")
    return flat.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("samples"), positive.alias("positive"),
        (F.count(F.lit(1)) - positive).alias("negative"), (positive / F.count(F.lit(1))).alias("prevalence"),
    )


def probability_summary(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per class: quartiles and the share of confident scores."""
    quart = exact_quantiles(predictions, [*keys, "label"], "probability", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    confident = F.when(F.col("label") == 1, F.col("probability") > 0.9).otherwise(F.col("probability") < 0.1)
    share = predictions.groupBy(*keys, "label").agg(F.avg(confident.cast("int")).alias("confident_share"))
    return quart.join(share, [*keys, "label"])


def probability_histogram(predictions: DataFrame, keys: Sequence[str], bins: int = 30) -> DataFrame:
    """Counts per label in equal bins on [0, 1], empty bins included."""
    hits = predictions.groupBy(*keys, "label", probability_bin(F.col("probability"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    frame = predictions.select(*keys).distinct().withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    return frame.join(hits, [*keys, "label", "bin"], "left").fillna(0, ["n"])


def feature_rows(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form ``(keys, feature, value)``."""
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features
    ])).alias("v")).select(*keys, "v.*")


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number between ``low`` and ``high + 1e-9``."""
    width = (high + 1e-9 - low) / bins
    return F.least(F.greatest(F.floor((value - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")


def feature_histogram(df: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int) -> DataFrame:
    """Counts of positives and negatives per feature bin; all bins present."""
    counts = feature_rows(df, [*keys, "label"], features).groupBy(*keys, "feature", "value").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    extent = counts.groupBy(*keys, "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = counts.join(extent, [*keys, "feature"]).groupBy(
        *keys, "feature", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")
    ).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = extent.select(*keys, "feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(binned, [*keys, "feature", "bin"], "left").fillna(0, ["pos", "neg"])


def grid_label_crosstab(manifest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return manifest.groupBy(*keys, "grid_cell").agg(
        F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives")
    )


def occurrence_stats(rows: DataFrame, source_rows: int) -> DataFrame:
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), pos.alias("positive"), neg.alias("negative"),
        (neg / F.greatest(pos, F.lit(1))).alias("neg_pos_ratio"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")],
    ).withColumn("source_rows", F.lit(source_rows))


def natural_summary(labelled: DataFrame) -> DataFrame:
    """Totals of a natural-prevalence labelling with ``outcome`` in positive / negative / ambiguous / failed."""
    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return labelled.agg(
        (n("positive") + n("negative")).alias("eligible"), n("positive").alias("positive"), n("negative").alias("negative"),
        ratio(n("positive"), n("positive") + n("negative")).alias("prevalence"), n("ambiguous").alias("ambiguous_excluded"),
        n("failed").alias("failed"),
    )


def download_accounting(ledger: DataFrame) -> DataFrame:
    """Files, bytes and frames by source and status."""
    return ledger.groupBy("source", "status").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("new_files").alias("files"), F.sum("new_bytes").alias("bytes")
    )
