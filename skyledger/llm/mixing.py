"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source has a weight and a cap of ``epochs`` times its own size. A common level is raised
until the clamped targets use up the budget; in the order of cap per weight the sources below
the level are a prefix, so the level follows from prefix sums, without iterating.

Defined cases: null or wordless text has size 0 and is never repeated; null sources are one
source of their own, last in order; an empty table gives an empty result; repeated rows count
as often as they occur; rows that share an id are ordered by size and text hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.ranges import prefix_sums
from skyledger.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the sampling order that name a bucket: a source is dealt to 16**3 buckets.
BUCKET_DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, seed: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` in a struct, with size, source and place in the sampling order."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return docs.select(
        F.struct(*keep).alias("_row"), F.col("doc_id").alias("_id"), word_count().alias("_size"),
        F.col("source").isNull().alias("_nosource"), F.coalesce("source", F.lit("")).alias("_source"),
        draw.alias("_draw"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_tie"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """Targets of ``sizes(_nosource, _source, _total)``: weights repeat in code-point order.

    The order, and the prefix sums along cap per weight, are range-partitioned, so there may be
    any number of sources.
    """
    placed = prefix_sums(sizes, [F.col("_nosource"), F.col("_source")], {"_place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    weighted = placed.select("_nosource", "_source", "_total", weight.cast("bigint").alias("_weight"))
    order = [F.col("_total") / F.col("_weight"), F.col("_nosource"), F.col("_source")]
    filled = cut(prefix_sums(weighted, order, {"_caps": F.col("_total") * epochs, "_weights": F.col("_weight")}))
    budget, all_weights = filled.agg(F.coalesce(F.sum("_total"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    caps_before = F.col("_caps") - F.col("_total") * epochs
    weights_left = F.lit(all_weights) - F.col("_weights") + F.col("_weight")
    levels = filled.withColumn("_level", (F.lit(budget) - caps_before) / weights_left)
    open_ = levels.where(F.col("_total") * epochs >= F.col("_level") * F.col("_weight"))
    # the first source that is not clamped; the level is constant from there on
    level = open_.agg(F.min_by("_level", F.struct(F.col("_total") / F.col("_weight"), F.col("_caps")))).first()[0]
    return filled.select(
        "_nosource", "_source", "_total", "_weight",
        F.least(F.col("_total") * F.lit(float(epochs)), F.lit(float(level or 0.0)) * F.col("_weight")).alias("_target"),
    )


def repetitions(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """``rows`` of ``sized`` with ``_total``, ``_target`` and the number of repetitions ``_times``.

    Each row is repeated ``floor(target / total)`` times; the rest of the target is filled once
    more in the seeded order while the running size, counted to a row's middle, stays within it.
    The running size is summed inside (source, bucket) and shifted by the buckets before, so
    the largest window holds 1/4096 of a source.
    """
    keys = ["_nosource", "_source"]
    rows = rows.withColumn("_bucket", F.substring("_draw", 1, BUCKET_DIGITS))
    buckets = cut(rows.groupBy(*keys, "_bucket").agg(F.sum("_size").alias("_part")))
    targets = source_targets(buckets.groupBy(*keys).agg(F.sum("_part").alias("_total")), weights, epochs)
    prior = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = buckets.join(targets, keys).select(
        *keys, "_bucket", "_total", "_target", F.coalesce(F.sum("_part").over(prior), F.lit(0)).alias("_shift")
    )
    local = Window.partitionBy(*keys, "_bucket").orderBy("_draw", "_id", "_size", "_tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0))
    middle = F.col("_shift") + F.col("_run") - F.col("_size") / 2
    more = (F.col("_size") > 0) & (middle <= F.col("_target") - F.col("_whole") * F.col("_total"))
    return (
        rows.join(shifts, [*keys, "_bucket"])
        .withColumn("_run", F.sum("_size").over(local))
        .withColumn("_whole", F.when(F.col("_size") > 0, whole).otherwise(F.lit(0)))
        .withColumn("_times", F.least(F.col("_whole") + more.cast("bigint"), F.lit(epochs)))
    )


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """The mixed corpus: every column of ``docs``, each row as often as the mix takes it."""
    taken = repetitions(sized(docs, seed, docs.columns), weights, epochs).where("_times > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int")))).select("_row.*")


def mix_plan(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, times, taken."""
    rows = cut(sized(docs, seed, ["source"]))
    return repetitions(rows, weights, epochs).select(
        F.col("_id").alias("doc_id"), F.col("_row.source").alias("source"), F.col("_size").alias("size"),
        F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_times").alias("times"),
        (F.col("_times") * F.col("_size")).alias("taken"),
    )
