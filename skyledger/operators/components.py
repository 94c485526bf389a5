"""Grouping by chains of near neighbours (connected components)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import geo, timegrid
from skyledger.operators.ranking import global_rank
from skyledger.session import cut, packed, partitions_for


def _is_star_forest(pairs: DataFrame, keys: list[str]) -> bool:
    """Every child has one parent and no parent is a child."""
    ends = pairs.select(*keys, F.col("a").alias("v"), F.lit(1).alias("up")).unionAll(
        pairs.select(*keys, F.col("b").alias("v"), F.lit(0).alias("up"))
    )
    seen = ends.groupBy(*keys, "v").agg(F.sum("up").alias("up"), F.count_if(F.col("up") == 0).alias("down"))
    return seen.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest member id of each node's component.

    ``nodes(keys, id)``, ``edges(keys, a, b)``; components never cross ``keys``. Alternating
    large-star and small-star steps (Kiveris et al. 2014) contract every component to a star
    in O(log^2 n) rounds; each round is two aggregations and joins over edges, checkpointed.
    A vertex with very many edges only meets its one minimum in a join, so AQE may split it.
    Rounds over few edges run in few partitions.
    """
    keys = list(keys)
    pairs = packed(edges.select(
        *keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a <> b").distinct())
    while not _is_star_forest(pairs, keys):
        few = partitions_for(pairs.count())
        both = pairs.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            pairs.select(*keys, F.col("b").alias("u"), F.col("a").alias("v"))
        )
        lowest = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(lowest, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("a"), F.col("m").alias("b")).coalesce(few)
        roots = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(roots, [*keys, "a"]).where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = packed(small.unionAll(roots.select(*keys, "a", F.col("m").alias("b"))).coalesce(2 * few).distinct())
    labels = pairs.select(*keys, F.col("a").alias("id"), F.col("b").alias("_root"))
    return nodes.select(*keys, "id").join(labels, [*keys, "id"], "left").select(
        *keys, "id", F.coalesce("_root", "id").alias("component")
    )


def storm_groups(
    active: DataFrame, minutes: float = 60.0, km: float = 75.0, numbered: bool = True
) -> DataFrame:
    """Chains of active slots within unit distance in scaled (time, x, y) of their centroids.

    Longitude is scaled at the mean latitude of all slots. A slot is one row, so an hour
    holds at most six candidates and a bucket's neighbourhood is bounded.
    """
    mean_lat = active.agg(F.avg("centroid_lat")).first()[0]
    if mean_lat is None:
        return active.withColumns({"storm_root": F.lit(None).cast("bigint"), "storm_id": F.lit(None).cast("string")})
    scaled = active.select(
        timegrid.slot_number(F.col("frame_time")).alias("id"),
        (F.unix_seconds("frame_time") / 60.0 / minutes).alias("t"),
        (F.col("centroid_lon") * geo.KM_PER_DEGREE * math.cos(math.radians(mean_lat)) / km).alias("x"),
        (F.col("centroid_lat") * geo.KM_PER_DEGREE / km).alias("y"),
    )
    axes = ("t", "x", "y")
    left = scaled.select("id", *axes, *[F.floor(a).alias(f"b{a}") for a in axes])
    right = left.select(F.col("id").alias("id2"), *[F.col(a).alias(f"{a}2") for a in axes], *[f"b{a}" for a in axes])
    for a in axes:
        right = right.withColumn(f"b{a}", F.explode(F.array(*[F.col(f"b{a}") + d for d in (-1, 0, 1)])))
    d2 = sum((F.col(a) - F.col(f"{a}2")) * (F.col(a) - F.col(f"{a}2")) for a in axes)
    edges = left.join(right, [f"b{a}" for a in axes]).where((F.col("id") > F.col("id2")) & (F.sqrt(d2) <= 1.0)).select(
        F.col("id").alias("a"), F.col("id2").alias("b")
    )
    labels = connected_components(scaled.select("id"), edges)
    out = active.withColumn("id", timegrid.slot_number(F.col("frame_time"))).join(labels, "id").drop("id")
    if not numbered:
        return out.withColumnRenamed("component", "storm_root")
    roots = global_rank(labels.select("component").distinct(), [], ["component"], "number")
    return out.join(roots, "component").withColumn(
        "storm_id", F.concat(F.lit("DERIVED_STORM_"), F.format_string("%06d", F.col("number") - 1))
    ).drop("number").withColumnRenamed("component", "storm_root")


def _box_bounds(a: str, b: str) -> tuple[Column, Column]:
    """Distance bounds (km) between two extents with column prefixes ``a`` and ``b``."""

    def c(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    def gap(axis: str) -> Column:
        return F.greatest(c(a, f"{axis}_lo") - c(b, f"{axis}_hi"), c(b, f"{axis}_lo") - c(a, f"{axis}_hi"), F.lit(0.0))

    def reach(axis: str) -> Column:
        return F.greatest(c(a, f"{axis}_hi") - c(b, f"{axis}_lo"), c(b, f"{axis}_hi") - c(a, f"{axis}_lo"))

    def cosines(side: str) -> tuple[Column, Column]:
        one, two = F.cos(F.radians(c(side, "lat_lo"))), F.cos(F.radians(c(side, "lat_hi")))
        top = F.when((c(side, "lat_lo") <= 0) & (c(side, "lat_hi") >= 0), F.lit(1.0)).otherwise(F.greatest(one, two))
        return F.least(one, two), top

    def km(dlat: Column, dlon: Column, cos: Column) -> Column:
        dp, dl = F.sin(F.radians(dlat) / 2), F.sin(F.radians(dlon) / 2)
        return F.lit(2 * geo.RADIUS_KM_V1) * F.asin(F.sqrt(F.least(dp * dp + cos * dl * dl, F.lit(1.0))))

    low_a, top_a = cosines(a)
    low_b, top_b = cosines(b)
    return km(gap("lat"), gap("lon"), low_a * low_b), km(reach("lat"), reach("lon"), top_a * top_b)


def frame_clusters(points: DataFrame, frame: str, eps_km: float = 20.0) -> DataFrame:
    """Haversine clusters inside each frame: one row per (frame, cell) with its cluster.

    A cell is small enough that all its points belong together, so only cells are linked.
    Whether two cells touch is decided by the extents of their occupied parts, halving the
    parts until every pair is clearly near or clearly far; single points decide last. No
    pairs of points of a crowded cell are ever formed.
    """
    step = eps_km / math.sqrt(2.0) / 111.2
    located = points.select(F.col(frame).alias("frame"), "lat", "lon").distinct().withColumns({
        "cy": F.floor(F.col("lat") / step), "cx": F.floor(F.col("lon") / step),
    })
    located = cut(located)

    def parts(side: str, divide: int) -> DataFrame:
        size = step / divide
        return located.groupBy(
            "frame", F.col("cy").alias(f"{side}y"), F.col("cx").alias(f"{side}x"),
            F.floor(F.col("lat") / size).alias(f"{side}_sy"), F.floor(F.col("lon") / size).alias(f"{side}_sx"),
        ).agg(
            F.min("lat").alias(f"{side}_lat_lo"), F.max("lat").alias(f"{side}_lat_hi"),
            F.min("lon").alias(f"{side}_lon_lo"), F.max("lon").alias(f"{side}_lon_hi"),
        )

    cells = located.groupBy("frame", "cy", "cx").agg(F.max(F.abs("lat")).alias("reach_lat"))
    k = F.ceil(F.lit(1.42) / F.cos(F.radians(F.least(F.col("reach_lat") + 1.0, F.lit(89.0))))).cast("int")
    ahead = (
        cells.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("dx", F.explode(F.sequence(-k, k)))
        .where("dy > 0 or dx > 0")
        .select("frame", F.col("cy").alias("ay"), F.col("cx").alias("ax"), (F.col("cy") + F.col("dy")).alias("by"), (F.col("cx") + F.col("dx")).alias("bx"))
    )
    here = cells.select("frame", F.col("cy").alias("by"), F.col("cx").alias("bx"))
    pair = ["frame", "ay", "ax", "by", "bx"]
    open_pairs = ahead.join(here, ["frame", "by", "bx"]).select(*pair)
    part_key = ["a_sy", "a_sx", "b_sy", "b_sx"]
    linked = None
    divide, previous = 1, None
    while True:
        a, b = parts("a", divide), parts("b", divide)
        if previous is None:
            candidates = open_pairs.join(a, ["frame", "ay", "ax"]).join(b, ["frame", "by", "bx"])
        else:
            # children of the still undecided parts only
            up = 8.0
            a = a.withColumn("a_uy", F.floor(F.col("a_lat_lo") / (step / divide * up))).withColumn(
                "a_ux", F.floor(F.col("a_lon_lo") / (step / divide * up)))
            b = b.withColumn("b_uy", F.floor(F.col("b_lat_lo") / (step / divide * up))).withColumn(
                "b_ux", F.floor(F.col("b_lon_lo") / (step / divide * up)))
            renamed = previous.select(*pair, *[F.col(c).alias(c.replace("_s", "_u")) for c in part_key])
            candidates = renamed.join(a, ["frame", "ay", "ax", "a_uy", "a_ux"]).join(b, ["frame", "by", "bx", "b_uy", "b_ux"])
        lower, upper = _box_bounds("a", "b")
        tested = cut(candidates.select(*pair, *part_key, (upper <= eps_km).alias("near"), (lower > eps_km).alias("far")))
        found = tested.where("near").select(*pair).distinct()
        linked = found if linked is None else linked.unionByName(found)
        previous = cut(tested.where("not near and not far").join(found, pair, "left_anti").select(*pair, *part_key))
        if previous.isEmpty():
            break
        divide *= 8
    # cell numbers stay far below 2^24 for any spacing above a few metres
    def node(y: str, x: str) -> Column:
        return F.col(y) * F.lit(1 << 24) + F.col(x)

    nodes = cells.select("frame", "cy", "cx", node("cy", "cx").alias("id"))
    edges = linked.select("frame", node("ay", "ax").alias("a"), node("by", "bx").alias("b"))
    labels = connected_components(nodes, edges, ["frame"])
    return labels.join(nodes, ["frame", "id"]).select("frame", "cy", "cx", "component")


def storm_ledger(ledger: DataFrame, train_end: str, val_end: str, minutes: float = 60.0, km: float = 75.0) -> DataFrame:
    """Storm and split per slot: active slots by storm, empty slots as singletons."""
    active = storm_groups(ledger.where("category = 'active'"), minutes, km)
    latest = active.groupBy("storm_id").agg(F.max("frame_time").alias("_latest"))
    active = active.join(latest, "storm_id").withColumn(
        "split", timegrid.split_by_instant(F.col("_latest"), train_end, val_end)
    ).drop("_latest", "storm_root")
    zero = ledger.where("category <> 'active'").withColumns({
        "storm_id": F.concat(F.lit("ZERO_RECORDED_"), F.date_format("frame_time", "yyyyMMdd_HHmm")),
        "split": timegrid.split_by_instant(F.col("frame_time"), train_end, val_end),
    })
    return active.unionByName(zero)
