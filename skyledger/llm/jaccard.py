"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

Jaccard distance ``1 - |A & B| / |A | B|`` is a metric. Documents at distance 1 from every pivot
(nearly all, in text) cannot be told apart by pivots, so a join starts from coarse *cells* in
which every linked pair meets:

1. Equal sets are one node, represented by their smallest doc_id.
2. *Keys.* Linked sets share one of their rarest elements (``rare_keys``); the nodes with one such
   key are its group. Groups overlap.
3. *Cells.* Two nodes of a group are joined if their sizes and the number of their common keys leave
   room for a link (the bounds need no texts). Groups are contracted by rounds of pivots, and what
   still spans components is tested inside tasks, each with each; the components are the cells.
   A link never leaves its cell, and since an edge must pass bounds that are close to a link, cells
   stay near the true components instead of running together.
4. *Regions.* Texts are sent once, to their cell. There pivots are chosen, every node goes to the
   region of its nearest pivot, and is copied to each region whose pivot is within
   ``nearest + 2 * tau``; any linked pair then meets where its smaller node is at home, and is
   counted there alone. Regions are split again, by Spark while they exceed ``leaf_rows`` or ``leaf_elements`` and
   inside the task below that, until few nodes are left, which are compared exactly.
5. The links found are contracted to components.

Nothing is dropped, capped or sampled: only pivots are chosen, which changes speed, not links.
A region that pivots cannot split (dense near copies, whose links are counted) is cut into blocks,
each with each, which keeps tasks bounded.

Defined cases: a null or wordless text has the empty set and is linked with nothing; repeated
rows and equal texts are linked with each other; rows that share a doc_id are one document with
several texts and get one component; a null doc_id keeps its row, with a null component and no
links; the empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.cells import blocked, members_of, once, pivot_rounds
from skyledger.llm.ranges import free
from skyledger.llm.rare_keys import describe_sets, overlap_needed
from skyledger.llm.words import lowered_words, rows, scramble, shingle_set
from skyledger.session import cut

# ---- a region in memory


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a matrix product over blocks of elements."""
    out = np.zeros((len(sets), len(others)), np.float32)
    if not sets or not others:
        return out.astype(np.int64)
    left, right = np.concatenate(sets), np.concatenate(others)
    both = np.intersect1d(left, right)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = np.repeat(np.arange(len(others)), [len(s) for s in others])
    if not len(both):
        return out.astype(np.int64)

    def placed(values, owner):
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    (la, lo), (ra, ro) = placed(left, row), placed(right, col)
    step = max(64, 4_000_000 // max(len(sets), len(others)))
    for start in range(0, len(both), step):
        width = min(step, len(both) - start)
        a, b = np.zeros((len(sets), width), np.float32), np.zeros((len(others), width), np.float32)
        i, j = np.searchsorted(la, (start, start + width)), np.searchsorted(ra, (start, start + width))
        a[lo[i[0] : i[1]], la[i[0] : i[1]] - start] = 1
        b[ro[j[0] : j[1]], ra[j[0] : j[1]] - start] = 1
        out += a @ b.T
    return np.rint(out).astype(np.int64)


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, share: Fraction) -> np.ndarray:
    """``|A & B| >= share * |A | B|`` in integers."""
    return common * share.denominator >= (n[:, None] + m[None, :] - common) * share.numerator


def distances(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1.0 - common / np.maximum(n[:, None] + m[None, :] - common, 1)


class Region:
    """Nodes whose links are found: union-find, and the number of links of each, weighted by copies."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], copies: list[int]):
        self.ids, self.sets = np.array(ids, np.int64), sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.copies = np.array(copies, np.int64)
        self.up = list(range(len(sets)))
        self.links = np.zeros(len(sets), np.int64)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)

    def compare(self, left: np.ndarray, right: np.ndarray, share: Fraction) -> None:
        """Links of ``left`` with those of ``right`` that have larger ids."""
        for a in range(0, len(left), 1024):
            one = left[a : a + 1024]
            for b in range(0, len(right), 1024):
                other = right[b : b + 1024]
                same = linked(overlaps([self.sets[i] for i in one], [self.sets[i] for i in other]), self.sizes[one], self.sizes[other], share)
                same &= self.ids[one][:, None] < self.ids[other][None, :]
                self.links[one] += same @ self.copies[other]
                self.links[other] += self.copies[one] @ same
                for i in np.nonzero(same.any(1))[0]:
                    for r in {self.root(int(x)) for x in other[same[i]]}:
                        self.join(int(one[i]), r)

    def find(self, members: np.ndarray, owner: np.ndarray, share: Fraction, small: int = 64, pivots: int = 8) -> None:
        """All links between ``members`` whose smaller node is an owner; recursive and exact."""
        if not owner.any():
            return
        if len(members) <= small:
            self.compare(members[owner], members, share)
            return
        tau = float(1 - share) + 1e-9
        chosen = members[np.linspace(0, len(members) - 1, pivots).astype(int)]  # members are in order of a hash
        far = np.concatenate([distances(overlaps([self.sets[i] for i in part], [self.sets[p] for p in chosen]), self.sizes[part], self.sizes[chosen])
                              for part in np.array_split(members, -(-len(members) // 1024))])
        home = far.argmin(1)
        inside = far <= far.min(1, keepdims=True) + 2 * tau
        work = sum(int(inside[:, p].sum()) * int((owner & (home == p)).sum()) for p in range(pivots))
        if work > 0.7 * len(members) * int(owner.sum()):  # the pivots tell too little apart
            self.compare(members[owner], members, share)
            return
        for p in range(pivots):
            here = inside[:, p]
            self.find(members[here], (owner & (home == p))[here], share, small, pivots)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _regions(share: Fraction, size: int):
    """Of each region, links that span its components (a, b) and numbers of links (a, links); one region is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sets, owner, copies = None, [], [], [], []

        def done():
            region = Region(ids, sets, copies)
            order = np.argsort(scramble(region.ids.view(np.uint64)), kind="stable")
            region.find(order, np.array(owner, bool)[order], share)
            found = [(ids[i], ids[region.root(i)], None) for i in range(len(ids)) if region.root(i) != i]
            found += [(i, None, int(n)) for i, n in zip(ids, region.links, strict=True) if n]
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], schema=_LINKS)

        for batch in batches:
            for at, doc_id, own, n, text in rows(batch, 256):
                if at != current:
                    if len(ids) > 1:
                        yield done()
                    current, ids, sets, owner, copies = at, [], [], [], []
                ids.append(doc_id), owner.append(own), copies.append(n)
                sets.append(shingle_set(lowered_words(text), size))
        if len(ids) > 1:
            yield done()
    return run


_PLACES = pa.schema([("region", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("home", pa.bool_())])


def _to_pivots(share: Fraction, size: int):
    """Cogroup of a slab of a region with the region's pivots: the pivots b whose regions node a goes to."""
    tau = float(1 - share) + 1e-9

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = sorted(zip(right["_id"].to_pylist(), right["_text"].to_pylist(), strict=True))
        names, pivots = np.array([h[0] for h in held], np.int64), [shingle_set(lowered_words(h[1]), size) for h in held]
        m = np.array([len(p) for p in pivots], np.int64)
        out = ([], [], [], [])
        for at in range(0, left.num_rows if held else 0, 256):
            part = left.slice(at, 256)
            sets = [shingle_set(lowered_words(t), size) for t in part["_text"].to_pylist()]
            far = distances(overlaps(sets, pivots), np.array([len(s) for s in sets], np.int64), m)
            home = far.argmin(1)
            i, p = np.nonzero(far <= far.min(1, keepdims=True) + 2 * tau)
            for column, value in zip(out, (part["region"].to_numpy()[i], part["_id"].to_numpy()[i], names[p], home[i] == p), strict=True):
                column.append(value)
        return pa.table([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(out, _PLACES, strict=True)], schema=_PLACES)
    return run


def _heavy(leaf_rows: int, leaf_elements: int):
    """Load of a region as a share of what a task should hold, by rows and by elements ``n``."""
    return F.greatest(F.count(F.lit(1)) / leaf_rows, F.sum("n") / leaf_elements)


def _split_large(nodes: DataFrame, texts: DataFrame, share: Fraction, size: int, leaf_rows: int, leaf_elements: int, slab: int, pivots: int) -> DataFrame:
    """``nodes(region, _id, n, owner)`` in regions of up to ``leaf_rows`` and ``leaf_elements``, by Voronoi rounds on Spark.

    Each round deals a large region to slabs of some ``slab`` rows, joins each slab with the
    region's pivots (one for each residue of a hash), and copies rows to the regions of the
    pivots inside their windows. A region that did not shrink to ``limit`` (four fifths of its
    parent) is cut into blocks instead: each block owns the links with each block.
    """
    nodes = nodes.withColumn("limit", F.lit(float("inf")))
    final = nodes.where("false")
    while True:
        sizes = nodes.groupBy("region").agg(F.count(F.lit(1)).alias("_n"), _heavy(leaf_rows, leaf_elements).alias("_load"), F.max("limit").alias("_limit"))
        large = cut(sizes.where(F.col("_load") > 1))
        if large.isEmpty():
            return final.unionByName(nodes).select("region", "_id", "owner")
        final = final.unionByName(nodes.join(large.select("region"), "region", "left_anti"))
        stuck = nodes.join(large.where("_load > _limit").select("region"), "region")
        final = final.unionByName(blocked(stuck, leaf_rows, leaf_elements).withColumn("limit", F.lit(0.0)), allowMissingColumns=True)
        slabs = F.ceil(F.col("_n") / slab).cast("int")
        busy = cut(nodes.join(large.where("_load <= _limit"), "region").withColumn("_slab", F.pmod(F.xxhash64("_id"), slabs).cast("int")))
        draw = F.xxhash64("_id", F.lit(7))
        taken = busy.groupBy("region", F.pmod(draw, F.lit(pivots)).alias("_k")).agg(
            F.min(F.struct(draw.alias("_o"), "_id")).alias("_p"), F.max("_n").alias("_n"))
        chosen = taken.select("region", F.col("_p._id").alias("_id"), F.explode(F.sequence(F.lit(0), slabs - 1)).alias("_slab"))
        left = busy.select("region", "_slab", "_id").join(texts, "_id")
        right = chosen.join(texts, "_id").select("_id", "region", "_slab", "_text").toDF("_id", "region", "_slab", "_text")
        places = left.groupBy("region", "_slab").cogroup(right.groupBy("region", "_slab")).applyInArrow(
            _to_pivots(share, size), "region bigint, a bigint, b bigint, home boolean")
        nodes = cut(places.withColumnRenamed("a", "_id").join(busy.select("region", "_id", "n", "owner", "_load"), ["region", "_id"]).select(
            F.xxhash64("region", "b").alias("region"), "_id", "n", (F.col("owner") & F.col("home")).alias("owner"), (F.col("_load") * 0.8).alias("limit")))


def _join_regions(cells: DataFrame, texts: DataFrame, share: Fraction, size: int, leaf_rows: int, leaf_elements: int, slab: int, pivots: int) -> DataFrame:
    """(a, b, links) of ``cells(region, _id, n, copies)`` by regions. Only texts of large cells are sent again, once a round."""
    large = cut(cells.groupBy("region").agg(_heavy(leaf_rows, leaf_elements).alias("_load")).where("_load > 1").select("region"))
    columns = ("region", "_id", "owner", "copies", "_text")
    small = cells.withColumn("owner", F.lit(True))
    if large.isEmpty():
        placed = small.join(texts, "_id").select(*columns)
    else:
        big = cut(small.join(large, "region", "left_semi"))
        held = cut(big.select("_id").join(texts, "_id"))
        split = _split_large(big.select("region", "_id", "n", "owner"), held, share, size, leaf_rows, leaf_elements, slab, pivots)
        placed = small.join(large, "region", "left_anti").join(texts, "_id").select(*columns).unionAll(
            split.join(big.select("_id", "copies"), "_id").join(held, "_id").select(*columns))
    sorted_ = placed.repartition("region").sortWithinPartitions("region", "_id")
    return cut(sorted_.mapInArrow(_regions(share, size), "a bigint, b bigint, links bigint"))


# ---- cells


def _room(share: Fraction):
    """Whether nodes a and b (n_lo to n_hi elements, keys) may be linked, as columns."""
    p, q = share.numerator, share.denominator

    def c(side: str, name: str):
        return F.col(f"{side}.{name}")

    sizes = (c("l", "n_hi") * q >= c("r", "n_lo") * p) & (c("r", "n_hi") * q >= c("l", "n_lo") * p)
    rest = F.ceil(F.greatest(c("l", "n_hi"), c("r", "n_hi")) * p / q) - 1
    needed = F.ceil((c("l", "n_lo") + c("r", "n_lo")) * p / (p + q))
    return sizes & (F.size(F.array_intersect(c("l", "keys"), c("r", "keys"))) + rest >= needed)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(share: Fraction):
    """Edges that span what the bounds join in each group; one group is held at a time."""
    p, q = share.numerator, share.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done():
            ids, owner, comps, low, high, keys = zip(*held, strict=True)
            order, low, high, owner = np.array(ids, np.int64), np.array(low, np.int64), np.array(high, np.int64), np.array(owner, bool)
            label = np.unique(np.array(comps, np.int64), return_inverse=True)[1]
            rest, a, b = -(-high * p // q) - 1, [], []
            for at in range(0, len(ids), 512):
                part = slice(at, at + 512)
                common = overlaps([np.unique(np.array(k, np.int64)) for k in keys[part]], [np.unique(np.array(k, np.int64)) for k in keys])
                fits = (high[part, None] * q >= low[None] * p) & (high[None] * q >= low[part, None] * p)
                fits &= common + np.maximum(rest[part, None], rest[None]) >= overlap_needed(low[part, None], low[None], share)
                fits &= owner[part, None] & (order[part, None] < order[None])
                for i in np.nonzero(fits.any(1))[0]:
                    for j in np.nonzero(fits[i])[0]:
                        if label[at + i] != label[j]:
                            a.append(ids[at + i]), b.append(ids[j])
                            label[label == label[j]] = label[at + i]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)

        for batch in batches:
            for region, *row in rows(batch, 256):
                if region != current:
                    if len(held) > 1:
                        yield done()
                    current, held = region, []
                held.append(row)
        if len(held) > 1:
            yield done()
    return run


def candidate_cells(groups: DataFrame, nodes: DataFrame, share: Fraction, leaf_rows: int = 2048) -> DataFrame:
    """(node, comp): the cells of ``groups(key, node)``; ``nodes(node, n_lo, n_hi)``. Nodes without a partner are left out."""
    held = cut(groups.groupBy("node").agg(F.collect_set("key").alias("keys")).join(nodes, "node"))

    def meet(pairs: DataFrame) -> DataFrame:
        side = F.struct("n_lo", "n_hi", "keys")
        met = pairs.join(held.select(F.col("node").alias("a"), side.alias("l")), "a").join(held.select(F.col("node").alias("b"), side.alias("r")), "b")
        return met.where(_room(share)).select("a", "b")

    edges, left = pivot_rounds(groups, meet)
    if edges is None:
        return nodes.select("node", F.col("node").alias("comp")).where("false")
    if not left.isEmpty():
        rest = blocked(once(left).withColumn("owner", F.lit(True)), leaf_rows).join(
            members_of(edges).select(F.col("node").alias("_id"), F.col("comp").alias("_comp")), "_id", "left").join(held.withColumnRenamed("node", "_id"), "_id")
        placed = rest.withColumn("comp", F.coalesce("_comp", "_id")).repartition("region").sortWithinPartitions("region", "_id")
        more = placed.select("region", "_id", "owner", "comp", "n_lo", "n_hi", "keys").mapInArrow(_edges(share), "a bigint, b bigint")
        edges = cut(edges.unionAll(more).distinct())
    return members_of(edges)


def link_documents(docs: DataFrame, size: int = 3, share: Fraction = Fraction(9, 10), leaf_rows: int = 8192,
                   leaf_elements: int = 1 << 23, slab: int = 1024, pivots: int = 16) -> DataFrame:
    """One row per document: doc_id, n_shingles, copies (rows with the same set), component_id, n_links.

    ``n_links`` counts the other rows that a row is linked with, equal ones included.
    """
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    described, keys = describe_sets(texts, share, size)
    full = described.where("n > 0 and _id is not null")
    nodes = cut(full.groupBy("n", "d1", "d2").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    classes = nodes.select(F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "node", "copies")
    same = (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    members = cut(described.join(classes, same, "left").select("_id", "n", "copies", "node"))
    owners = members.where("node is not null").select("_id", "node").distinct()
    keyed = cut(keys.join(owners, "_id").select("key", "node").distinct())
    shared = keyed.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select("key")
    spread = nodes.groupBy("node").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("copies").alias("copies"))
    cells = cut(candidate_cells(cut(keyed.join(shared, "key")), spread.select("node", "n_lo", "n_hi"), share).join(spread, "node").select(
        F.col("comp").alias("region"), F.col("node").alias("_id"), F.col("n_hi").alias("n"), "copies"))
    found = _join_regions(cells, texts, share, size, leaf_rows, leaf_elements, slab, pivots)
    several = owners.groupBy("_id").agg(F.min("node").alias("b"), F.max("node").alias("_last")).where("b < _last").select("_id", "b")
    same_id = owners.join(several, "_id").where("node <> b").select(F.col("node").alias("a"), "b")
    comps = members_of(cut(found.where("b is not null").select("a", "b").unionAll(same_id).distinct()))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("_links"))
    known = F.col("_id").isNotNull() & (F.col("n") > 0)
    return members.join(comps, "node", "left").join(counts, "node", "left").select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("copies", F.lit(1)).alias("copies"),
        F.when(F.col("_id").isNotNull(), F.coalesce("comp", "node", "_id")).alias("component_id"),
        F.when(known, F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Every column of ``docs`` for one row of each component: that of the smallest doc_id.

    Of repeated rows of that doc_id the one with the smallest text stays; rows without a doc_id
    all stay. The semi-join is on doc_id, so no group meets in one task.
    """
    labelled = link_documents(docs, **options)
    name, place = free(docs.columns, "_stay"), free(docs.columns, "_place")
    stay = labelled.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(stay, docs["doc_id"] == F.col(name), "left_semi")
    one = Window.partitionBy("doc_id").orderBy("text")
    return kept.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).drop(place).unionByName(docs.where("doc_id is null"))
