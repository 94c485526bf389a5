"""Validators and go / no-go gates: every check is a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def family(model: Column, source: Column) -> Column:
    return (
        F.when(source == "neural", "neural")
        .when(model.rlike("^(mean_channel|b13_min)"), "simple_image")
        .when(model.contains("latlon"), "geographic").otherwise("other")
    )


def best_per_family(models: DataFrame) -> DataFrame:
    """Best model of each family by average precision, the name breaking ties."""
    rows = models.withColumn("family", family(F.col("model"), F.col("source")))
    order = F.struct((-F.col("pr_auc")).alias("p"), "model", "source", "pr_auc", "roc_auc")
    return rows.groupBy("family").agg(F.min(order).alias("b")).select("family", "b.model", "b.source", "b.pr_auc", "b.roc_auc")


def advantage_verdict(best: DataFrame) -> DataFrame:
    """Does the neural model beat the simple baselines? Fixed margins of .02 and .05."""
    def score(name: str) -> Column:
        return F.max(F.when(F.col("family") == name, F.col("pr_auc"))).alias(name)

    row = best.agg(score("neural"), score("simple_image"), score("geographic"))
    n, i, g = F.col("neural"), F.col("simple_image"), F.col("geographic")
    return row.withColumn(
        "verdict",
        F.when(n.isNull() | i.isNull() | g.isNull(), "inconclusive").when(n <= i + 0.02, "no meaningful advantage")
        .when((n > i + 0.05) & (n > g + 0.05), "meaningful discrimination").otherwise("limited advantage"),
    )


def check_rows(df: DataFrame, checks: dict[str, Column], example: str, keep: int = 3) -> DataFrame:
    """One row per check with the number of violations and the smallest examples."""
    flat = df.select(F.explode(F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(n).alias("check"), F.col(example).cast("string").alias("example"))) for n, c in checks.items()
    ]))).alias("v")).select("v.*")
    # one row per distinct example before anything is ranked
    per = flat.groupBy("check", "example").agg(F.count(F.lit(1)).alias("n"))
    return summarise_checks(per, list(checks), keep)


def summarise_checks(per: DataFrame, names: Sequence[str], keep: int = 3) -> DataFrame:
    """``per(check, example, n)`` to one row per named check, zeros included."""
    from skyledger.operators.ranking import take_per_group

    total = per.groupBy("check").agg(F.sum("n").alias("violations"))
    first = take_per_group(per, ["check"], ["example"], keep).groupBy("check").agg(
        F.array_join(F.array_sort(F.collect_list("example")), ",").alias("examples")
    )
    every = per.sparkSession.createDataFrame([(n,) for n in names], "check string")
    return every.join(total, "check", "left").join(first, "check", "left").select(
        "check", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("examples", F.lit("")).alias("examples")
    )


def manifest_checks(manifest: DataFrame, expected_split: Column, required: Sequence[str]) -> DataFrame:
    """Missing columns, duplicate paths, frames and dates in several splits, wrong splits, image after its strike."""
    missing = [c for c in required if c not in manifest.columns]
    rows = check_rows(manifest, {
        "split_mismatch": F.col("split") != expected_split, "image_after_strike": F.col("frame_time") > F.col("ts"),
    }, "path")
    paths = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(
        F.lit("duplicate_path").alias("check"), F.col("path").alias("example"), (F.col("c") - 1).alias("n")
    )

    def crossing(column: str, name: str) -> DataFrame:
        return manifest.groupBy(column).agg(F.countDistinct("split").alias("s")).where("s > 1").select(
            F.lit(name).alias("check"), F.col(column).cast("string").alias("example"), F.lit(1).cast("bigint").alias("n")
        )

    groups = paths.unionByName(crossing("frame_id", "frame_in_several_splits")).unionByName(
        crossing("date", "date_in_several_splits")
    )
    counted = summarise_checks(groups, ["duplicate_path", "frame_in_several_splits", "date_in_several_splits"])
    lacking = manifest.sparkSession.createDataFrame(
        [("missing_columns", len(missing), ",".join(missing))], "check string, violations bigint, examples string"
    )
    return rows.unionByName(counted).unionByName(lacking)


def split_overlap(manifest: DataFrame, keys: dict[str, Column], lists: dict[str, Column] | None = None) -> DataFrame:
    """Values shared by each pair of splits, and repeats inside a split, for every kind of key."""
    scalar = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in keys.items()])
    flat = manifest.select("split", F.explode(scalar).alias("v")).select("split", "v.*")
    for kind, column in (lists or {}).items():
        flat = flat.unionByName(manifest.select("split", F.lit(kind).alias("kind"), F.explode(column).alias("value")))
    sides = flat.where(F.col("value").isNotNull()).groupBy("kind", "value").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    )

    def both(a: str, b: str) -> Column:
        return F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias(f"{a}_{b}")

    inside = sum((F.greatest(F.col(s) - 1, F.lit(0)) for s in ("train", "val", "test")), F.lit(0))
    return sides.groupBy("kind").agg(
        both("train", "val"), both("train", "test"), both("val", "test"), F.sum(inside).alias("within_split_repeats")
    )


def crop_repeats(manifest: DataFrame, scope: str) -> DataFrame:
    """Crops that occur more than once inside a frame (or another scope)."""
    return manifest.groupBy(F.lit(scope).alias("scope"), F.col(scope).alias("group"), "x0", "y0").agg(
        F.count(F.lit(1)).alias("copies"), F.countDistinct("label").alias("labels")
    ).where("copies > 1")


def gate(checks: dict[str, Column], row: DataFrame, decision: tuple[str, str]) -> DataFrame:
    """(criterion, pass) rows plus the overall decision, from a one-row table of facts."""
    flat = row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("criterion"), F.coalesce(c, F.lit(False)).alias("pass")) for n, c in checks.items()
    ])).alias("g")).select("g.*")
    verdict = flat.agg(F.bool_and("pass").alias("pass")).select(
        F.when(F.col("pass"), decision[0]).otherwise(decision[1]).alias("criterion"), "pass"
    )
    return flat.unionByName(verdict)


def unlock_gate(runs: DataFrame, plan: dict[str, int], final: Sequence[str]) -> DataFrame:
    """Whether all configured runs are there: ``plan`` gives the number of values of each setting.

    The numbers come from the configuration, so a missing architecture or seed locks the gate.
    """
    from math import prod

    facts = runs.agg(F.countDistinct(*plan).alias("candidates"), F.countDistinct(*final).alias("finals"))
    return gate({
        "candidate_runs": F.col("candidates") == prod(plan.values()), "final_runs": F.col("finals") == prod(plan[c] for c in final),
    }, facts, ("unlock", "locked"))


def score_sanity(predictions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    from skyledger.functions.scores import sigmoid

    p = F.col("probability")
    return predictions.groupBy("run_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if((p < 0) | (p > 1) | p.isNull()).alias("out_of_range"),
        F.count_if(F.abs(sigmoid(F.col("logit")) - p) > tolerance).alias("logit_mismatch"),
    )
