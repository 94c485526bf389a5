"""Order-dependent building blocks that never put a whole group on one task.

A plain window over a hot key sorts that key's rows in one task. The helpers here
aggregate first and split the order into ranges:

* ``global_rank`` ranks rows inside arbitrarily large groups with range partitions,
* ``running_totals`` builds prefix sums over a coarse-to-fine order,
* ``exact_quantiles`` reads linear-interpolated quantiles off those prefix sums,
* ``take_per_group`` keeps the first ``n`` rows of each group with a map-side cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import cut


# largest window rank limit that Spark's optimizer turns into a map-side cut by default
GROUP_LIMIT = 1000


def take_per_group(df: DataFrame, keys: Sequence, order: Sequence, n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group; Spark trims each map task before the shuffle."""
    name = rank or "_take"
    if n > GROUP_LIMIT:
        named = {f"_key{i}": k for i, k in enumerate(keys) if isinstance(k, Column)}
        plain = [k for k in keys if not isinstance(k, Column)] + list(named)
        ranked = global_rank(df.withColumns(named), plain, list(order), name).where(F.col(name) <= n).drop(*named)
        return ranked if rank else ranked.drop(name)
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest in ``order``; a partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_first"))
    return picked.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def global_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence, rank: str = "rank", partitions: int | None = None
) -> DataFrame:
    """1-based ``row_number`` per ``keys`` in a total ``order``, for groups of any size.

    Rows are range-partitioned on (keys, order) and written to the checkpoint folder, so
    the partition number of a row is a fact rather than something recomputed; each range
    is ranked alone and shifted by the row counts of the ranges before it.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"),
    )
    local = Window.partitionBy("_range", *keys).orderBy(*order)
    ranked = ranged.withColumn("_local", F.row_number().over(local))
    condition = F.col("_range") == F.col("_r")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return (
        ranked.join(shifts, condition)
        .withColumn(rank, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .drop("_range", "_r", "_local", "_shift", *[f"_k_{k}" for k in keys])
    )


def logit_buckets(score: str, descending: bool = False) -> Column:
    """Monotone bucket of a probability, fine near 0 and 1; at most some 75,000 values."""
    p = F.col(score).cast("double")
    z = (
        F.when(p.isNull() | (p <= 0), F.lit(-1000.0))
        .when(p >= 1, F.lit(1000.0))
        .otherwise(F.ln(p / (F.lit(1.0) - p)))
    )
    return F.floor(z * 1024).cast("int") * (-1 if descending else 1)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], bucket: Column, descending: bool = False
) -> DataFrame:
    """Inclusive running sums ``cum_*`` along ``order`` and group totals ``all_*`` inside ``keys``.

    ``df`` must hold one row per (keys, order). ``bucket`` is a monotone coarse version of
    ``order`` with a bounded number of values: rows are summed inside their bucket and
    shifted by the totals of the buckets before it, so no window holds a whole group.
    """
    out = df.withColumn("_b", bucket)
    direction = F.desc if descending else F.asc
    window = (
        Window.partitionBy(*keys, "_b").orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = out.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(prior), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"all_{s}") for s in sums],
    )
    local = out.select("*", *[F.sum(s).over(window).alias(f"_c_{s}") for s in sums])
    return local.join(offsets, [*keys, "_b"]).select(
        *df.columns, *[(F.col(f"_c_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
    )


def running_max(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], bucket: Column) -> DataFrame:
    """Maximum of each value over the rows strictly before, split by bucket like ``running_totals``."""
    out = df.withColumn("_b", bucket)
    window = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = out.groupBy(*keys, "_b").agg(*[F.max(v).alias(f"_t_{v}") for v in values])
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(*keys, "_b", *[F.max(f"_t_{v}").over(prior).alias(f"_o_{v}") for v in values])
    local = out.select("*", *[F.max(v).over(window).alias(f"_c_{v}") for v in values])
    return local.join(offsets, [*keys, "_b"]).select(
        *df.columns, *[F.greatest(f"_c_{v}", f"_o_{v}").alias(f"prior_{v}") for v in values]
    )


def value_totals(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Pre-aggregate by distinct value and attach running totals and group totals.

    The distinct values are dealt to ranges that hold about equally many of them, whatever
    their distribution, and are written once; a range's number is the bucket.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    agg = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(k) for k, c in sums.items()])
    ranged = cut(agg.repartitionByRange(n, *keys, value).withColumn("_range", F.spark_partition_id()))
    return running_totals(ranged, keys, value, list(sums), F.col("_range")).drop("_range")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, without buffering a group."""
    totals = value_totals(df, keys, value, {"n": F.count(F.lit(1))})
    picks = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("all_n") - 1)
        picks += [
            F.min(F.when(F.col("cum_n") > F.floor(position), F.col(value))).alias(f"_{name}_lo"),
            F.min(F.when(F.col("cum_n") > F.ceil(position), F.col(value))).alias(f"_{name}_hi"),
        ]
    ends = totals.groupBy(*keys).agg(F.max("all_n").alias("n"), *picks)
    outs = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return ends.select(*keys, "n", *outs)
