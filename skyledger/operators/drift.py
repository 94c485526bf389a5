"""Balance and drift between positives and negatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.ranking import value_totals
from skyledger.operators.summaries import feature_histogram, feature_rows, grid_label_crosstab

EPS = 1e-6


def _divergences(p: Column, q: Column) -> dict[str, Column]:
    m = (p + q) / 2
    return {
        "jensen_shannon_divergence": F.sum(p * F.ln(p / m) + q * F.ln(q / m)) / 2,
        "population_stability_index": F.sum((p - q) * F.ln(p / q)),
    }


def ks_statistic(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance, from running counts over distinct values."""
    rows = feature_rows(df, [*keys, "label"], features)
    totals = value_totals(
        rows, [*keys, "feature"], "value", {"pos": F.sum("label"), "neg": F.sum(1 - F.col("label"))}
    )
    gap = F.abs(F.col("cum_pos") / F.col("all_pos") - F.col("cum_neg") / F.col("all_neg"))
    return totals.groupBy(*keys, "feature").agg(
        F.max(gap).alias("ks_statistic"), F.max("all_pos").alias("n_pos"), F.max("all_neg").alias("n_neg")
    )


def ks_pvalue(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value."""
    scaled = F.sqrt(n * m / (n + m)) * statistic
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(k * k * scaled * scaled * -2.0),
    )
    return F.when(scaled < 0.04, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))


def balance_drift(df: DataFrame, keys: Sequence[str], features: Sequence[str], bins: int = 10) -> DataFrame:
    """Positive against negative means, SMD, Jensen-Shannon, PSI and KS per feature."""
    rows = feature_rows(df, [*keys, "label"], features)
    pos, neg = F.when(F.col("label") == 1, F.col("value")), F.when(F.col("label") == 0, F.col("value"))
    moments = rows.groupBy(*keys, "feature").agg(
        F.avg(pos).alias("positive_mean"), F.avg(neg).alias("negative_mean"),
        F.sqrt((F.var_samp(pos) + F.var_samp(neg)) / 2).alias("_pooled"),
    )
    smd = F.coalesce(F.try_divide(F.col("positive_mean") - F.col("negative_mean"), F.col("_pooled")), F.lit(0.0))
    hist = feature_histogram(df, keys, features, bins)
    sums = hist.groupBy(*keys, "feature").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    p = (F.col("pos") + EPS) / (F.col("all_pos") + EPS * bins)
    q = (F.col("neg") + EPS) / (F.col("all_neg") + EPS * bins)
    div = hist.join(sums, [*keys, "feature"]).groupBy(*keys, "feature").agg(
        *[c.alias(n) for n, c in _divergences(p, q).items()]
    )
    ks = ks_statistic(df, keys, features)
    return moments.withColumn("standardized_mean_difference", smd).drop("_pooled").join(div, [*keys, "feature"]).join(
        ks, [*keys, "feature"]
    )


def grid_js(manifest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Jensen-Shannon divergence of the cell occupancy, and occupied cells per label."""
    cells = grid_label_crosstab(manifest, keys).withColumns({"p": F.col("positives") + EPS, "q": F.col("negatives") + EPS})
    sums = cells.groupBy(*keys).agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    if keys:
        joined = cells.join(sums, list(keys))
    else:
        total = sums.first()
        joined = cells.withColumns({"sp": F.lit(total["sp"]), "sq": F.lit(total["sq"])})
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    return joined.groupBy(*keys).agg(
        _divergences(p, q)["jensen_shannon_divergence"].alias("jensen_shannon_divergence"),
        F.count_if(F.col("positives") > 0).alias("occupied_cells_positive"),
        F.count_if(F.col("negatives") > 0).alias("occupied_cells_negative"),
    )
