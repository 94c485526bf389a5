"""Overlapping cells of nodes in which all links lie, contracted by rounds of pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.operators.components import connected_components
from skyledger.session import packed, partitions_for

#: Rounds of pivots: the pivots of a cell in each, and the most that a node meets, over all its cells (0 counts as 1); what is left is for the caller.
ROUNDS = (0, 4, 4)


def members_of(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of ``links(a, b)``."""
    ends = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).distinct()
    return connected_components(ends, links).select(F.col("id").alias("node"), F.col("component").alias("comp"))


def _labels(links: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of ``links(node, pivot)``: equal labels are in one component, if not always the reverse.

    Every node takes the smallest of its pivots and then follows theirs, some steps far.
    """
    few = partitions_for(links.count())
    up = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("comp", "node").alias("comp")).coalesce(few)
    for _ in range(2):
        ahead = up.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
        up = up.join(ahead, "comp", "left").select("node", F.coalesce("_next", "comp").alias("comp")).coalesce(few)
    return packed(up)


def _mixed(cells: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The cells (key, node, comp) that span several components."""
    labelled = cells.withColumn("comp", F.col("node")) if comps is None else cells.join(comps, "node", "left").select(
        "key", "node", F.coalesce("comp", "node").alias("comp"))
    spans = labelled.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    return labelled.join(spans.select("key"), "key")


def pivot_rounds(cells: DataFrame, meet: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """Links found with the pivots of ``cells(key, node)``, and the cells that still span several components.

    ``meet`` gives the linked ones of pairs (a, b). Pivots come from the smallest components, by an
    order that is the same in all cells of a round; nodes of a pivot's own component need not meet it.
    A node meets as many pivots as a cell has, however many cells hold it, so the pairs of a round grow
    with the nodes and not with the sizes of their cells.
    """
    links = comps = None
    for turn, pivots in enumerate(ROUNDS):
        cells = packed(_mixed(cells, comps))
        if cells.isEmpty():
            break
        few = partitions_for(cells.count())
        sizes = cells.select("node", "comp").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("_size"))
        draw = F.xxhash64("node", F.lit(3 + turn))
        taken = cells.join(sizes, "comp").coalesce(few).groupBy("key", F.pmod(draw, F.lit(max(pivots, 1))).alias("_k")).agg(
            F.min(F.struct("_size", draw.alias("_o"), "node", "comp")).alias("_p"))
        taken = taken.select("key", F.col("_p.node").alias("b"), F.col("_p.comp").alias("_comp"))
        order = F.xxhash64("b", F.lit(3 + turn))
        pairs = cells.join(taken, "key").where("comp <> _comp").select(F.col("node").alias("a"), "b").groupBy(
            "a", F.pmod(order, F.lit(max(pivots, 1))).alias("_k")).agg(F.min(F.struct(order.alias("_o"), "b")).alias("_b")).select("a", "_b.b")
        found = meet(packed(pairs))
        links = packed(found if links is None else links.unionAll(found))
        comps = _labels(links)
        cells = cells.select("key", "node")
    else:
        cells = _mixed(cells, comps)
    return links, packed(cells.select("key", "node"))


def once(cells: DataFrame) -> DataFrame:
    """(region, _id): of cells with the same nodes one."""
    mark = F.xxhash64("node", F.lit(9))
    signed = cells.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(mark).alias("_x"), F.bit_xor(F.xxhash64(mark)).alias("_y"))
    first = signed.groupBy("_n", "_x", "_y").agg(F.min("key").alias("key")).select("key")
    return cells.join(first, "key").select(F.col("key").alias("region"), F.col("node").alias("_id"))


def blocked(nodes: DataFrame, rows: int, elements: int | None = None) -> DataFrame:
    """``nodes(region, _id, owner)``, where a region of over ``rows`` becomes blocks, each of which owns the links with each.

    With ``elements``, blocks are also bounded by the sum of ``n``.
    """
    load = F.count(F.lit(1)) / rows
    load = load if elements is None else F.greatest(load, F.sum("n") / elements)
    sizes = nodes.groupBy("region").agg(load.alias("_load"))
    blocks = F.when(F.col("_load") > 1, F.ceil(F.col("_load") * 2)).otherwise(1).cast("int")
    placed = nodes.join(sizes.withColumn("_blocks", blocks), "region").withColumn("_mine", F.pmod(F.xxhash64("_id", F.lit(5)), "_blocks").cast("int"))
    each = placed.withColumn("_k", F.explode(F.sequence(F.lit(0), 2 * F.col("_blocks") - 1)))
    other, guest = (F.col("_k") / 2).cast("int"), F.col("_k") % 2 == 1
    return each.where(~guest | (other != F.col("_mine"))).select(
        F.when(guest, F.xxhash64("region", other, "_mine")).otherwise(F.xxhash64("region", "_mine", other)).alias("region"), "_id", (F.col("owner") & ~guest).alias("owner"))
