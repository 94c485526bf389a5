"""Deduplication, thinning, quotas, stratified and diversity selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo
from skyledger.functions.hashing import hash_order, uniform
from skyledger.operators.ranking import first_per_key, global_rank, running_max, take_per_group
from skyledger.session import cut


def dedup_strikes(strikes: DataFrame, frame: str | None = None) -> DataFrame:
    """One strike per (instant, latitude, longitude) at five decimals, the first in raw order."""
    keyed = strikes.withColumns({"_lat5": F.bround("lat", 5), "_lon5": F.bround("lon", 5)})
    keys = [*([frame] if frame else []), "ts", "_lat5", "_lon5"]
    return first_per_key(keyed, keys, ["lat", "lon", "solution_key"]).drop("_lat5", "_lon5")


_POINT = "struct<ts:timestamp,lat:double,lon:double,solution_key:string>"


def _keep(rows: Column, start: Column, spacing_km: float, cap: int) -> Column:
    """Greedy thinning of an ordered array, continuing from already kept points."""

    def near(kept: Column, x: Column) -> Column:
        return F.exists(kept, lambda k: geo.haversine(k["lat"], k["lon"], x["lat"], x["lon"]) < spacing_km)

    return F.aggregate(
        rows, start,
        lambda kept, x: F.when((F.size(kept) >= cap) | near(kept, x), kept).otherwise(F.concat(kept, F.array(x))),
    )


def spaced_strikes(strikes: DataFrame, frame: str, spacing_km: float = 30.0, cap: int = 20, chunk: int = 512) -> DataFrame:
    """Kept strikes per frame as an ordered array ``kept`` of at most ``cap`` points.

    In (ts, lat, lon) order a strike is kept when it is at least ``spacing_km`` from every
    kept one. Each round takes the next ``chunk`` strikes of a frame as an array; strikes
    beyond it survive only if clear of everything kept so far. The first survivor of a round
    is always kept, so ``cap`` rounds suffice, and usually one does.
    """
    empty = F.array().cast(f"array<{_POINT}>")
    point = F.struct("ts", "lat", "lon", "solution_key").cast(_POINT).alias("p")
    left = strikes.select(F.col(frame).alias("_f"), point)
    kept = None
    while True:
        head = take_per_group(left, ["_f"], ["p"], chunk)
        rows = head.groupBy("_f").agg(F.array_sort(F.collect_list("p")).alias("rows"))
        if kept is None:
            state = rows.withColumn("kept", empty)
        else:
            state = kept.join(rows, "_f", "left").withColumn("rows", F.coalesce("rows", empty))
        new = cut(state.select(
            "_f", _keep(F.col("rows"), F.col("kept"), spacing_km, cap).alias("kept"),
            F.when(F.size("rows") > 0, F.element_at("rows", -1)).alias("last"),
        ))
        clear = F.forall("kept", lambda k: geo.haversine(k["lat"], k["lon"], F.col("p.lat"), F.col("p.lon")) >= spacing_km)
        left = cut(
            left.join(new, "_f").where((F.size("kept") < cap) & (F.col("p") > F.col("last")) & clear).select("_f", "p")
        )
        kept = new.select("_f", "kept")
        if left.isEmpty():
            return kept.select(F.col("_f").alias(frame), "kept")


def removal_stats(strikes: DataFrame, frame: str, spacing_km: float = 30.0, cap: int = 20) -> DataFrame:
    """Per frame: candidates, duplicates, removed by spacing or cap, retained."""
    unique = dedup_strikes(strikes, frame)
    total = strikes.groupBy(frame).agg(F.count(F.lit(1)).alias("candidate"))
    left = unique.groupBy(frame).agg(F.count(F.lit(1)).alias("_u"))
    kept = spaced_strikes(unique, frame, spacing_km, cap).select(frame, F.size("kept").cast("bigint").alias("retained"))
    return total.join(left, frame).join(kept, frame).select(
        frame, "candidate", (F.col("candidate") - F.col("_u")).alias("deduplicated"),
        (F.col("_u") - F.col("retained")).alias("spacing_or_cap_removed"), "retained",
    )


def retained_strikes(strikes: DataFrame, frame: str, spacing_km: float = 30.0, cap: int = 20) -> DataFrame:
    """Thinned strikes as rows with their 0-based ``number`` in the frame."""
    kept = spaced_strikes(dedup_strikes(strikes, frame), frame, spacing_km, cap)
    return kept.select(frame, F.posexplode("kept").alias("number", "p")).select(frame, "number", "p.*")


def interleave(frames: DataFrame, weights: dict[str, float], preferred: Column | None = None) -> DataFrame:
    """Chronological frames of every split, interleaved so any prefix follows the weights.

    The greedy rule "next is the split with the least emitted/weight" equals sorting by
    ``(rank in split - 1) / weight`` with the order of the splits breaking ties.
    """
    preference = F.lit(0) if preferred is None else F.when(preferred, 0).otherwise(1)
    ranked = global_rank(frames.withColumn("_pref", preference), ["split"], ["_pref", "frame_time"], "_rn")
    return ranked.withColumn("turn", _turn(weights)).withColumn("turn_split", _split_index(weights)).drop("_pref", "_rn")


def _turn(weights: dict[str, float]) -> Column:
    weight = F.lit(0.01)
    for split, value in weights.items():
        weight = F.when(F.col("split") == split, value).otherwise(weight)
    return (F.col("_rn") - 1) / weight


def _split_index(weights: dict[str, float]) -> Column:
    index = F.lit(99)
    for i, split in enumerate(weights):
        index = F.when(F.col("split") == split, i).otherwise(index)
    return index


def head_per_day(frames: DataFrame, n: int) -> DataFrame:
    return take_per_group(frames, [F.to_date("frame_time")], ["frame_time"], n)


def select_frames(frames: DataFrame, per_day: int, limit: int, weights: dict[str, float]) -> DataFrame:
    """First frames of each day, interleaved by split, up to a limit."""
    head = take_per_group(head_per_day(frames, per_day), ["split"], ["frame_time"], limit, "_rn")
    ordered = head.withColumn("_turn", _turn(weights)).withColumn("_si", _split_index(weights))
    return ordered.orderBy("_turn", "_si", "frame_time").limit(limit).drop("_rn", "_turn", "_si")


def stratified_pick(
    rows: DataFrame, count: int, seed: str, key: str, keys: Sequence[str] = (), prefer_cached: bool = True
) -> DataFrame:
    """``count`` rows per ``keys``: cached first, then balanced over strata, random inside.

    The greedy "least-picked stratum next" equals ordering by the random rank inside the
    stratum; ranks beyond ``count`` can never be picked.
    """
    first = F.col("cached") if prefer_cached else ~F.col("cached")
    rows = rows.withColumns({"_first": F.when(first, 0).otherwise(1), "_rand": hash_order(seed, key)})
    ranked = take_per_group(rows, [*keys, "stratum"], ["_first", "_rand"], count, "_rn")
    picked = take_per_group(ranked, keys or [F.lit(1)], ["_first", "_rn", "stratum"], count)
    return picked.drop("_first", "_rand", "_rn")


def quota_plan(rows: DataFrame, quotas: dict[tuple[str, str], int], seed: str, key: str) -> DataFrame:
    """``stratified_pick`` for every (split, category) quota in one pass."""
    quota = F.lit(0)
    for (split, category), n in quotas.items():
        quota = F.when((F.col("split") == split) & (F.col("category") == category), n).otherwise(quota)
    most = max(quotas.values())
    rows = rows.withColumns({
        "_quota": quota, "_first": F.when(F.col("cached"), 0).otherwise(1), "_rand": hash_order(seed, key),
    }).where("_quota > 0")
    ranked = take_per_group(rows, ["split", "category", "stratum"], ["_first", "_rand"], most, "_rn")
    final = take_per_group(ranked, ["split", "category"], ["_first", "_rn", "stratum"], most, "_pos")
    return final.where(F.col("_pos") <= F.col("_quota")).drop("_quota", "_first", "_rand", "_rn", "_pos")


def active_pool(rows: DataFrame, quotas: dict[str, int], seed: str) -> DataFrame:
    """Per split the ``max(15 n, 1000)`` frames with most retained positives, plus all cached ones."""
    return _pool(rows, quotas, lambda n: max(15 * n, 1000), [F.desc("retained"), "_random"], seed)


def zero_pool(rows: DataFrame, quotas: dict[str, int], seed: str) -> DataFrame:
    """Per split ``max(30 n, 1500)`` random empty frames, plus all cached ones."""
    return _pool(rows, quotas, lambda n: max(30 * n, 1500), ["_random"], seed)


def _pool(rows: DataFrame, quotas: dict[str, int], size: Callable[[int], int], order: list, seed: str) -> DataFrame:
    limit = F.lit(0)
    for split, n in quotas.items():
        limit = F.when(F.col("split") == split, size(n)).otherwise(limit)
    rows = rows.withColumn("_random", uniform(seed, F.unix_seconds("frame_time")))
    ranked = global_rank(rows, ["split"], [*order, "frame_time"], "_rank")
    return ranked.where((F.col("_rank") <= limit) | F.col("cached")).withColumnRenamed("_random", "random").drop("_rank")


def mix_key() -> Column:
    return F.concat_ws("|", "split", F.col("month").cast("string"), "local_time_block")


def _text_key(column: str) -> Column:
    """The value as a text that also keys nulls, so that they join."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _greedy_step(values: Sequence[str], bonus: Sequence[float], scale: float, batch: int):
    """Greedy picks among one split's best rows of every class, until a row outside of them could win.

    A row outside scores at most its class's lowest ``static`` here plus what the class's rows can
    still gain, and gains only fall.
    """

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("epoch").reset_index(drop=True)
        flags = [rows[f"_new_{i}"].to_numpy(bool) for i in range(len(values))]
        static, share, mix = rows["static"].to_numpy(), rows["share"].to_numpy(), rows["mix"].to_numpy()
        per, counts = rows["_per"].to_numpy(), rows["_n"].to_numpy(float).copy()
        keys = [rows[v].to_numpy() for v in values]
        classes = rows.groupby(["mix", *[f"_new_{i}" for i in range(len(values))]])["static"].agg(["size", "idxmin"])
        lowest = classes.loc[classes["size"] >= batch, "idxmin"].to_numpy()
        start = [f[lowest].copy() for f in flags]
        left, wanted, picks = np.ones(len(rows), bool), int(rows["_open"].iloc[0]), []

        def worth(at, new) -> np.ndarray:
            gain = np.zeros(len(at))
            for w, f in zip(bonus, new, strict=True):
                gain = gain + np.where(f, w, 0.0)
            return static[at] + gain + scale * (share[at] - counts[at] / per[at])

        every = np.arange(len(rows))
        while len(picks) < wanted and left.any():
            score = np.where(left, worth(every, flags), -np.inf)
            best = int(score.argmax())  # the earliest epoch of equal scores
            if picks and len(lowest) and score[best] <= worth(lowest, start).max():
                break
            picks.append(best)
            left[best] = False
            counts[mix == mix[best]] += 1
            for i, key in enumerate(keys):
                flags[i] &= key != key[best]
        out = rows.loc[picks, ["split", "epoch", "mix", *values]]
        return out.assign(pick=rows["_taken"].iloc[0] + np.arange(1, len(picks) + 1))

    return step


def lazy_greedy(
    pool: DataFrame, quotas: dict[str, int], bonus: dict[str, float], scale: float, per_quota: bool = False, batch: int = 64
) -> DataFrame:
    """Greedy picks per split: ``split, epoch, pick``, the picks counted from 1.

    A row is worth ``static``, the bonus of every column of ``bonus`` whose value no pick of the split
    has yet, and ``scale * (share - n / per)``, where n is the number of picks of its ``mix`` and
    ``per`` the split's quota (``per_quota``) or 1; equal rows go by epoch. ``pool`` has ``split,
    frame_time, mix, share, static`` and the columns of ``bonus``. Nulls there are one value.

    Picks are a table. Each round takes the pool without the picks, marks what is still new by joins
    with the distinct values of the picks, and keeps the ``batch`` best rows of each class (mix and
    marks): rows of a class keep their order by ``static`` while picks accumulate. One task a split
    picks among these rows, whose number is bounded by classes times ``batch``, as long as no other
    row could win. The driver sees the number of picks per split only.
    """
    spark, values = pool.sparkSession, list(bonus)
    pool = cut(pool.select(
        "split", F.unix_seconds("frame_time").alias("epoch"), "mix", F.col("share").cast("double"),
        F.col("static").cast("double"), *[_text_key(c).alias(c) for c in values],
    ))
    kinds = ", ".join(f"{c} string" for c in values)
    picks = spark.createDataFrame([], f"split string, epoch bigint, mix string, {kinds}, pick bigint")
    step = _greedy_step(values, list(bonus.values()), scale, batch)
    done = dict.fromkeys(quotas, 0)
    open_splits = {s for s, n in quotas.items() if n > 0}
    while open_splits:
        targets = spark.createDataFrame(
            [(s, quotas[s] - done[s], done[s], float(max(quotas[s], 1)) if per_quota else 1.0) for s in sorted(open_splits)],
            "split string, _open bigint, _taken bigint, _per double",
        )
        left = pool.join(picks.select("split", "epoch"), ["split", "epoch"], "left_anti").join(targets, "split")
        for i, c in enumerate(values):
            seen = picks.select("split", c).distinct().withColumn("_seen", F.lit(True))
            left = left.join(seen, ["split", c], "left").withColumn(f"_new_{i}", F.col("_seen").isNull()).drop("_seen")
        marks = [f"_new_{i}" for i in range(len(values))]
        top = take_per_group(left, ["split", "mix", *marks], [F.desc("static"), "epoch"], batch)
        counts = picks.groupBy("split", "mix").agg(F.count(F.lit(1)).alias("_n"))
        top = top.join(counts, ["split", "mix"], "left").fillna(0, ["_n"])
        found = top.groupBy("split").applyInPandas(step, picks.schema)
        picks = cut(picks.unionByName(found))
        now = {r["split"]: r["n"] for r in picks.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        open_splits = {s for s in open_splits if done[s] < now.get(s, 0) < quotas[s]}
        done |= now
    return picks.select("split", "epoch", "pick")


def _taste() -> Column:
    return F.when(F.col("cached"), 10.0).otherwise(0.0) + F.col("random")


def select_active(pool: DataFrame, quotas: dict[str, int], batch: int = 64) -> DataFrame:
    """Diversity pick: new dates and storms first, thin strata, many positives, cached, random."""
    static = F.least(F.col("retained").cast("double"), F.lit(10.0)) * 3.0 + _taste()
    rows = pool.withColumns({"mix": mix_key(), "static": static, "share": F.lit(0.0)})
    return lazy_greedy(rows, quotas, {"date": 120.0, "storm_id": 80.0}, 18.0, batch=batch)


def select_zero(pool: DataFrame, quotas: dict[str, int], mix: DataFrame, batch: int = 64) -> DataFrame:
    """Match the month and time-block mix of the active frames; ``mix`` has ``split, mix, share``."""
    rows = pool.withColumns({"mix": mix_key(), "static": _taste()}).join(mix, ["split", "mix"], "left")
    return lazy_greedy(rows.fillna(0.0, ["share"]), quotas, {"date": 20.0}, 100.0, True, batch)


def picked_rows(pool: DataFrame, picks: DataFrame) -> DataFrame:
    """Pool rows of the picks with their pick order."""
    return pool.withColumn("epoch", F.unix_seconds("frame_time")).join(picks, ["split", "epoch"]).drop("epoch")


def active_mix(active: DataFrame) -> DataFrame:
    """Share of each (split, month, time block) among the selected frames of the split."""
    counts = active.groupBy("split", mix_key().alias("mix")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("split").agg(F.sum("_n").alias("_all"))
    return counts.join(totals, "split").select("split", "mix", (F.col("_n") / F.col("_all")).alias("share"))


def balanced_sample(df: DataFrame, order: Sequence) -> DataFrame:
    """All positives and as many negatives, the first in ``order``."""
    negatives = global_rank(df.where("label = 0"), [], list(order), "_rn")
    positives = df.where("label = 1")
    return positives.unionByName(negatives.where(F.col("_rn") <= positives.count()).drop("_rn"))


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows per group at ``rint(linspace(0, n-1, k))`` of the order, all of them if fewer."""
    ranked = global_rank(df, keys, order, "_rn")
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = (F.col("_n") - 1) / float(max(k - 1, 1))
    spots = F.when(F.col("_n") <= k, F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.rint(i * step) + 1).cast("bigint"))
    )
    wanted = sizes.select(*keys, F.explode(F.array_distinct(spots)).alias("_rn"))
    return ranked.join(wanted, [*keys, "_rn"]).drop("_rn")


def distinct_frame_examples(outcomes: DataFrame, seed: str, key: str, n: int = 4) -> DataFrame:
    """First ``n`` TP, then ``n`` TN, in hash order, no frame used twice."""
    rows = outcomes.withColumn("_order", hash_order(seed, key))

    def first(outcome: str, df: DataFrame) -> DataFrame:
        one = first_per_key(df.where(F.col("outcome") == outcome), ["frame_id"], ["_order", key])
        return one.orderBy("_order", key).limit(n)

    tp = first("TP", rows)
    tn = first("TN", rows.join(tp.select("frame_id"), "frame_id", "left_anti"))
    return tp.unionByName(tn).drop("_order")


def early_stop(history: DataFrame, run: str, epoch: str, patience: int) -> DataFrame:
    """Best epoch and the epoch at which ``patience`` epochs had passed without improvement.

    An epoch improves on a higher score, or an equal score with a lower loss.
    """
    bucket = F.floor(F.col(epoch) / 4096)
    rows = history.withColumn("_q", F.struct(F.col("pr_auc").alias("a"), (-F.col("loss")).alias("b")))
    rows = running_max(rows, [run], epoch, ["_q"], bucket)
    better = F.col("prior__q").isNull() | (F.col("_q") > F.col("prior__q"))
    rows = rows.withColumn("_best", F.when(better, F.col(epoch)))
    rows = running_max(rows.drop("prior__q"), [run], epoch, ["_best"], bucket)
    last = F.greatest("_best", "prior__best")
    rows = rows.withColumn("_stale", F.col(epoch) - last)
    stop = rows.groupBy(run).agg(
        F.min(F.when(F.col("_stale") >= patience, F.col(epoch))).alias("stop_epoch"), F.max(epoch).alias("_last")
    )
    seen = rows.join(stop, run).where(F.col(epoch) <= F.coalesce("stop_epoch", "_last"))
    return seen.groupBy(run).agg(F.max("_best").alias("best_epoch"), F.first("stop_epoch").alias("stop_epoch"))


def primary_runs(runs: DataFrame, seeds: int) -> DataFrame:
    """Runs of the best complete (loss, augmentation) option of each architecture."""
    option = ["architecture", "loss_name", "augmentation"]
    groups = runs.groupBy(*option).agg(
        F.count(F.lit(1)).alias("n"), F.avg("validation_pr_auc").alias("pr"), F.avg("validation_loss").alias("loss")
    ).where(F.col("n") == seeds)
    best = groups.groupBy("architecture").agg(
        F.max(F.struct("pr", (-F.col("loss")).alias("l"), "loss_name", "augmentation")).alias("b")
    )
    chosen = best.select("architecture", "b.loss_name", "b.augmentation")
    return runs.join(chosen, option, "left_semi")
