"""Verification metrics over prediction tables.

Every metric starts from counts of positives and negatives per distinct score, so rows are
combined before the first shuffle; curves and areas are prefix sums over those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import scores as S
from skyledger.functions.hashing import uniform
from skyledger.operators.ranking import global_rank, logit_buckets, running_totals
from skyledger.session import cut

ALL_METRICS = [
    "accuracy", "balanced_accuracy", "precision", "recall_pod", "f1", "mcc", "roc_auc", "pr_auc", "brier_score",
    "expected_calibration_error", "false_discovery_ratio_far", "false_positive_rate_fpr", "hss", "tss",
]


def confusion(df: DataFrame, keys: Sequence[str], threshold: Column, score: str = "probability") -> DataFrame:
    cells = S.contingency(F.col(score) >= threshold, F.col("label") == 1)
    return df.groupBy(*keys).agg(*cells.values())


def score_counts(df: DataFrame, keys: Sequence[str], score: str = "probability") -> DataFrame:
    """Positives and negatives per distinct score.

    Curves, thresholds and areas read these counts several times, so they are written once
    rather than scanning the predictions again.
    """
    return cut(df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col("label")).cast("bigint").alias("pos"), F.sum(1 - F.col("label")).cast("bigint").alias("neg")
    ))


def curve(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts with hits and false alarms at every distinct score, highest first, and class totals.

    ``counts`` is read twice (scores and buckets); pass a materialised table.
    """
    run = running_totals(counts, keys, "score", ["pos", "neg"], logit_buckets("score", descending=True), descending=True)
    return run.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def area_columns() -> dict[str, Column]:
    """Aggregates over a curve: rank ROC-AUC and average precision, null for a single class."""
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    p, n = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    both = (p > 0) & (n > 0)
    return {
        "roc_auc": F.when(both, F.sum(neg * (tp - pos / 2)) / (p * n)),
        "pr_auc": F.when(both, F.sum(pos * tp / (tp + fp)) / p),
    }


def areas(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return curve(counts, keys).groupBy(*keys).agg(*[c.alias(n) for n, c in area_columns().items()])


def calibration_error(counts: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    per_bin = counts.groupBy(*keys, S.probability_bin(F.col("score"), bins).alias("bin")).agg(
        F.sum(F.col("score") * n).alias("sp"), F.sum("pos").alias("sy"), F.sum(n).alias("sn")
    )
    return per_bin.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("sn")).alias("expected_calibration_error")
    )


def reliability(counts: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    return counts.groupBy(*keys, S.probability_bin(F.col("score"), bins).alias("bin")).agg(
        F.sum(n).alias("n"), (F.sum(F.col("score") * n) / F.sum(n)).alias("mean_prediction"),
        (F.sum("pos") / F.sum(n)).alias("positive_fraction"),
    )


def metric_table(counts: DataFrame, keys: Sequence[str], threshold: Column) -> DataFrame:
    """All metrics per group from score counts; ``threshold`` may be a column of ``counts``."""
    pos, neg, p = F.col("pos"), F.col("neg"), F.col("score")
    hit = p >= threshold
    n = F.sum(pos + neg)
    base = counts.groupBy(*keys).agg(
        F.sum(F.when(~hit, neg).otherwise(0)).alias("tn"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, pos).otherwise(0)).alias("fn"), F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
        (F.sum(pos * F.pow(p - 1.0, F.lit(2.0)) + neg * F.pow(p, F.lit(2.0))) / n).alias("brier_score"),
        F.max(threshold).alias("threshold"),
    )
    out = base.join(areas(counts.select(*keys, "score", "pos", "neg"), keys), list(keys))
    out = out.join(calibration_error(counts, keys), list(keys))
    return out.withColumns(S.contingency_metrics())


def sweep(counts: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Contingency counts at every grid threshold, in one pass over the scores.

    A score is first reduced to the number of thresholds it reaches, so only
    ``len(grid) + 1`` rows per group are summed along the grid.
    """
    thresholds = F.array(*[F.lit(float(t)) for t in sorted(grid)])
    reach = F.size(F.filter(thresholds, lambda t: t <= F.col("score")))
    steps = counts.groupBy(*keys, reach.alias("reach")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = counts.select(*keys).distinct().select(*keys, F.posexplode(thresholds).alias("i", "threshold"))
    padded = (
        rows.select(*keys, (F.col("i") + 1).alias("reach"), "threshold")
        .unionByName(rows.where("i = 0").select(*keys, F.lit(0).alias("reach"), F.lit(None).cast("double").alias("threshold")))
        .join(steps, [*keys, "reach"], "left").fillna(0, ["pos", "neg"])
    )
    up = Window.partitionBy(*keys).orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = Window.partitionBy(*keys)
    return (
        padded.withColumns({
            "tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up),
            "_p": F.sum("pos").over(full), "_n": F.sum("neg").over(full),
        })
        .where(F.col("reach") > 0)
        .select(*keys, "threshold", (F.col("_n") - F.col("fp")).alias("tn"), "fp", (F.col("_p") - F.col("tp")).alias("fn"), "tp")
    )


def score_thresholds(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contingency counts with every distinct score as threshold."""
    return curve(counts, keys).select(
        *keys, F.col("score").alias("threshold"), (F.col("all_neg") - F.col("fp")).alias("tn"), "fp",
        (F.col("all_pos") - F.col("tp")).alias("fn"), "tp",
    )


def select_threshold(counts: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """F1-best threshold per group.

    ``model``: 0, .01 to .99, every score, 1 and the last maximum; ``baseline``: 0, every score,
    1 and the last maximum; ``grid``: .05 to .95 in 181 steps, must beat .5, first maximum;
    ``pilot``: .01 to .99 in 197 steps, first maximum.
    """
    def linspace(a: float, b: float, n: int) -> list[float]:
        step = (b - a) / (n - 1)
        return [i * step + a for i in range(n - 1)] + [b]

    if mode in ("model", "baseline"):
        fixed = [0.0, 1.0] + (linspace(0.01, 0.99, 99) if mode == "model" else [])
        candidates = sweep(counts, keys, fixed).unionByName(score_thresholds(counts, keys))
        best = F.max(F.struct("f1", "threshold"))
    elif mode == "grid":
        candidates = sweep(counts, keys, sorted({0.5, *linspace(0.05, 0.95, 181)}))
        # .5 wins a tie, then the lowest threshold
        candidates = candidates.withColumn("_first", F.when(F.col("threshold") == 0.5, 1.0).otherwise(-F.col("threshold")))
        best = F.max(F.struct("f1", "_first", "threshold"))
    elif mode == "pilot":
        candidates = sweep(counts, keys, linspace(0.01, 0.99, 197)).withColumn("_first", -F.col("threshold"))
        best = F.max(F.struct("f1", "_first", "threshold"))
    else:
        raise ValueError(mode)
    scored = candidates.withColumn("f1", S.contingency_metrics()["f1"])
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", "b.f1")


def minority_counts(counts: DataFrame) -> DataFrame:
    """Score counts with label 0 as the positive class and ``1 - p`` as score."""
    return counts.select(
        *[c for c in counts.columns if c not in ("score", "pos", "neg")], (F.lit(1.0) - F.col("score")).alias("score"),
        F.col("neg").alias("pos"), F.col("pos").alias("neg"),
    )


def bootstrap_draws(df: DataFrame, keys: Sequence[str], cluster: str, repeats: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Numbered clusters (``keys``, cluster, id) and one row (id, replicate) per draw, ``n`` of ``n`` with replacement.

    The draws of a replicate come one after the other, in pieces.
    """
    clusters = df.select(*keys, F.col(cluster).cast("string").alias("cluster")).distinct()
    ranked = cut(global_rank(clusters, keys, ["cluster"], "i"))
    # one row per group of ``keys``; the ids of a group follow those of the group before
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes = cut(sizes.dropna(subset=list(keys)))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pieces = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn(
        "_low", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(PIECE).cast("bigint"))))
    spread = pieces.repartition(max(_partitions(df), -(-total * repeats // TASK_DRAWS))).sortWithinPartitions("replicate")
    each = spread.withColumn("i", F.explode(F.sequence("_low", F.least(F.col("_low") + PIECE - 1, F.col("n")))))
    drawn = F.floor(uniform(seed, *keys, "replicate", "i") * F.col("n")) + 1
    draws = each.select((F.col("_start") + drawn).alias("id"), F.col("replicate").cast("int").alias("replicate"))
    numbered = ranked.join(F.broadcast(sizes), list(keys))
    return numbered.select(*keys, "cluster", (F.col("_start") + F.col("i")).alias("id")), draws


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Counted rows and draws that one task weighs together, and rows that it holds as a matrix at a time.
BUCKET_ROWS, BUCKET_DRAWS, BLOCK = 20_000, 4_000_000, 4096
#: Draws of a replicate that are made and packed together, and draws of a task that makes them.
PIECE, TASK_DRAWS = 1 << 20, 1 << 24


def _pack(buckets: int):
    """Draws as (bucket, replicate, places): the sorted places in a bucket as steps of a byte, 255 where a step goes on."""

    def packed(replicate: int, ids):
        import numpy as np
        import pyarrow as pa

        ids = np.concatenate(ids)
        width = int(ids.max()) // buckets + 1
        where = np.sort(ids % buckets * width + ids // buckets)
        bucket, place = np.divmod(where, width)
        heads = np.flatnonzero(np.diff(bucket, prepend=-1))
        steps = np.diff(place, prepend=0)
        steps[heads] = place[heads]
        ends = np.cumsum(steps // 255 + 1)
        coded = np.full(int(ends[-1]), 255, "uint8")
        coded[ends - 1] = steps % 255
        bounds = np.concatenate([[0], ends[heads[1:] - 1], ends[-1:]]).astype("int64")
        places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(coded)])
        return pa.record_batch({
            "_bucket": pa.array(bucket[heads]), "replicate": pa.array(np.full(len(heads), replicate, "int32")), "places": places.cast(pa.binary()),
        })

    def pack(batches):
        import numpy as np

        held, size, current = [], 0, None
        for batch in batches:
            ids, replicates = batch["id"].to_numpy(), batch["replicate"].to_numpy()
            starts = np.flatnonzero(np.diff(replicates, prepend=-1))
            for start, stop in zip(starts, [*starts[1:], len(ids)]):
                if held and (replicates[start] != current or size >= PIECE):
                    yield packed(current, held)
                    held, size = [], 0
                current = int(replicates[start])
                held.append(ids[start:stop])
                size += stop - start
        if held:
            yield packed(current, held)

    return pack


def _times(drawn, repeats: int, size: int):
    """How often each place of a bucket was drawn in each replicate."""
    import numpy as np

    out = np.zeros((repeats, size), "int32")
    for replicate, places in zip(drawn["replicate"].to_numpy(), drawn["places"].to_pylist()):
        steps = np.frombuffer(places, "uint8")
        at = np.cumsum(steps, dtype="int64")[steps != 255]
        out[replicate - 1] += np.bincount(at, minlength=size)[:size].astype("int32")
    return np.ascontiguousarray(out.T)


def _weigh(cells: Sequence[str], repeats: int, buckets: int):
    """Sums of a bucket's counts times the draws of their clusters: one row per cell, an entry per replicate."""

    def weigh(left, right):
        import numpy as np
        import pyarrow as pa

        if not len(left):  # clusters without counts have nothing to add
            return _append(left.select(cells), {name: pa.array([], pa.binary()) for name in ("pos", "neg")})
        where = left.select(cells).to_pandas().groupby(list(cells), dropna=False, sort=False)
        cell = where.ngroup().to_numpy()
        local = left["id"].to_numpy() // buckets
        times = _times(right, repeats, int(local.max()) + 1)
        n, sums = int(cell.max()) + 1, {}
        for name in ("pos", "neg"):
            counts = left[name].to_numpy()
            rows = np.flatnonzero(counts)
            rows = rows[np.argsort(cell[rows], kind="stable")]
            total = np.zeros((n, repeats), "int64" if int(np.abs(counts).sum()) * int(times.max(initial=0)) >= 2**31 else "int32")
            for start in range(0, len(rows), BLOCK):
                some = rows[start:start + BLOCK]
                heads = np.flatnonzero(np.diff(cell[some], prepend=-1))
                part = times[local[some]] * counts[some, None].astype(total.dtype)
                total[cell[some][heads]] += np.add.reduceat(part, heads, axis=0)
            sums[name] = _narrow(total)
        _, firsts = np.unique(cell, return_index=True)
        return _append(left.select(cells).take(pa.array(firsts)), sums)

    return weigh


def _narrow(matrix):
    """Each row of sums as bytes: the width of a number, then the numbers."""
    import numpy as np
    import pyarrow as pa

    out = []
    for row, top in zip(matrix, np.abs(matrix).max(axis=1, initial=0)):
        width = next(w for w in (1, 2, 4, 8) if w == 8 or top < 2 ** (8 * w - 1))
        out.append(bytes([width]) + row.astype(f"<i{width}").tobytes())
    return pa.array(out, pa.binary())


def _wide(vectors: list[bytes]):
    """The matrix of such rows."""
    import numpy as np

    return np.stack([np.frombuffer(v, f"<i{v[0]}", offset=1).astype("int64") for v in vectors])


def _add(cells: Sequence[str]):
    """Sums of the vectors of each cell."""

    def add(table):
        import numpy as np
        import pyarrow as pa

        cell = table.select(cells).to_pandas().groupby(list(cells), dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(cell, kind="stable")
        heads = np.flatnonzero(np.diff(cell[order], prepend=-1))
        sums = {}
        for name in ("pos", "neg"):
            values, total = table[name], None
            for start in range(0, len(order), BLOCK):
                some = order[start:start + BLOCK]
                part = _wide(values.take(pa.array(some)).to_pylist())
                total = np.zeros((len(heads), part.shape[1]), "int64") if total is None else total
                firsts = np.flatnonzero(np.diff(cell[some], prepend=-1))
                total[cell[some][firsts]] += np.add.reduceat(part, firsts, axis=0)
            ends = np.arange(len(total) + 1, dtype="int32") * total.shape[1]
            sums[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))
        return _append(table.select(cells).take(pa.array(order[heads])), sums)

    return add


def _append(cells, columns: dict):
    """The cells' table with more columns."""
    for name, column in columns.items():
        cells = cells.append_column(name, column)
    return cells


def clustered_counts(counts: DataFrame, clusters: DataFrame, draws: DataFrame, cells: Sequence[str], repeats: int) -> DataFrame:
    """(``cells``, replicate, pos, neg): the counts of every replicate.

    A cluster's counts and draws meet in the bucket of its id. Draws travel packed, about a byte each. A bucket
    multiplies them as matrices and sends one narrow vector per cell, which replaces a row for each count and replicate.
    """
    keys = [c for c in clusters.columns if c not in ("cluster", "id")]
    known = cut(counts.join(clusters, [*keys, "cluster"]).select(
        *cells, "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pos", "neg")]
    ))
    rows = known.count()
    buckets = max(_partitions(counts), -(-rows // BUCKET_ROWS), -(-clusters.count() * repeats // BUCKET_DRAWS))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*cells).schema.fields)
    left = known.select("*", F.pmod("id", F.lit(buckets).cast("bigint")).alias("_bucket"))
    right = draws.mapInArrow(_pack(buckets), "_bucket bigint, replicate int, places binary")

    def dealt(df: DataFrame):
        """Buckets on all tasks: what is packed is few bytes but much work, and a number that is given is not coalesced."""
        return df.repartition(_partitions(counts), "_bucket").groupBy("_bucket")

    parts = dealt(left).cogroup(dealt(right)).applyInArrow(_weigh(list(cells), repeats, buckets), f"{kinds}, pos binary, neg binary")
    # a bucket sends a vector for each of its rows at most
    spread = F.pmod(F.xxhash64(*cells), F.lit(max(_partitions(counts), -(-rows * 4 // BUCKET_ROWS)))).alias("_bucket")
    summed = dealt(parts.select("*", spread)).applyInArrow(_add(list(cells)), f"{kinds}, pos array<bigint>, neg array<bigint>")
    long = summed.select(*cells, F.posexplode(F.arrays_zip("pos", "neg")).alias("_r", "_s"))
    return long.select(*cells, (F.col("_r") + 1).alias("replicate"), "_s.pos", "_s.neg").where(F.col("pos") + F.col("neg") > 0)


def clustered_bootstrap(
    df: DataFrame, keys: Sequence[str], cluster: str, repeats: int = 500, seed: str = "boot",
    metrics: Sequence[str] = ALL_METRICS,
) -> DataFrame:
    """Percentile intervals of every metric, resampling whole clusters.

    ``df`` carries ``label``, ``probability`` and the frozen ``threshold``. Rows are reduced to
    counts per (cluster, score) before they meet the draws.
    """
    counts = score_counts(
        df.withColumn("cluster", F.col(cluster).cast("string")), [*keys, "cluster", "threshold"]
    )
    clusters, draws = bootstrap_draws(df, keys, cluster, repeats, seed)
    grouped = [*keys, "replicate"]
    weighted = clustered_counts(counts, clusters, draws, [*keys, "threshold", "score"], repeats)
    table = metric_table(cut(weighted), grouped, F.col("threshold"))
    long = table.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics
    ])).alias("m")).select(*keys, "m.*")
    # one value per replicate and metric: at most ``repeats`` values in a group
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "metric").agg(
        q.alias("q"), F.count(F.lit(1)).alias("valid_replicates")
    ).select(
        *keys, "metric", F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"),
        "valid_replicates",
    )


def subgroup_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], score: str = "probability") -> DataFrame:
    """Score counts per (column, value) of several grouping columns.

    Values are keyed by a text that ``group_value`` turns back, so that nulls join and stay a
    group of their own.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    flat = df.select(*keys, "label", score, F.explode(pairs).alias("g"))
    return score_counts(flat.select(*keys, "label", score, "g.column", F.coalesce(F.concat(F.lit("="), "g.value"), F.lit("")).alias("value")), [*keys, "column", "value"], score)


def group_value(value: str = "value") -> Column:
    """The group's value behind the key of ``subgroup_counts``; null for the null group."""
    return F.when(F.col(value) != "", F.substring(F.col(value), F.lit(2), F.length(value)))


def temperature_fit(df: DataFrame, keys: Sequence[str], rounds: int = 4, steps: int = 40) -> DataFrame:
    """Temperature in [.05, 20] with the lowest mean logistic loss.

    The loss is smooth in one variable, so each round evaluates a grid of log-temperatures
    around the best point of the previous one, in one aggregate over distinct logits.
    """
    counts = cut(df.groupBy(*keys, "logit", "label").agg(F.count(F.lit(1)).alias("n")))
    low, high = float(_ln(0.05)), float(_ln(20.0))
    state = counts.select(*keys).distinct().withColumns({"lo": F.lit(low), "hi": F.lit(high)})
    for _ in range(rounds):
        log_t = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / float(steps)
        grid = state.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("log_t", log_t)
        loss = S.log_loss(F.col("logit") / F.exp("log_t"), F.col("label"))
        losses = counts.join(grid, list(keys)).groupBy(*keys, "lo", "hi", "log_t").agg(
            (F.sum(loss * F.col("n")) / F.sum("n")).alias("loss")
        )
        best = losses.groupBy(*keys, "lo", "hi").agg(F.min(F.struct("loss", "log_t")).alias("b"))
        width = (F.col("hi") - F.col("lo")) / float(steps)
        state = best.select(
            *keys, F.greatest(F.col("b.log_t") - width, F.lit(low)).alias("lo"),
            F.least(F.col("b.log_t") + width, F.lit(high)).alias("hi"), F.col("b.log_t").alias("log_t"), F.col("b.loss").alias("loss"),
        )
    return state.select(*keys, F.exp("log_t").alias("temperature"), "loss")


def _ln(x: float) -> float:
    import math

    return math.log(x)


def long_metrics(table: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return table.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("m")).select(*keys, "m.*")
