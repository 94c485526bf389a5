"""Hard-negative mining: exact integer inner products by the Four-Russians method.

An anchor's vector is cut into groups of eight dimensions; for each group the sums of all 256
subsets of its components are computed once. A candidate's components are held as bit planes (the
highest counts negatively), eight dimensions of one plane to a byte. A score is then, from the
highest plane down, twice the score so far plus the looked-up subset sum of each group's byte:
shifts, look-ups and additions, with the full exact product as result.

Candidates are packed to slabs of bit-plane bytes, anchors are dealt to blocks by hash. Each cell of
the grid (block of anchors x part of the slabs) is one sorted run of rows in a task: it holds its
anchors and one slab at a time, keeps the best of each anchor, and sends these on. Memory is
bounded by the anchors of a block and one slab; neither labels nor ids decide where a row goes, so
a label of a third of all rows is no hot key. The first pass finds each anchor's positives, the
second its negatives within the bands that the positives' scores set. All anchors meet all rows:
nothing is sampled, and no index leaves rows out.

Defined cases: rows with a null label, a null vector, or any null, NaN or infinite component take
no part; an empty vector, and components that a shorter vector lacks, count as zeros; ``other`` rows
are those with another id; a repeated row is a candidate as often as it occurs, but a repeated
anchor (equal id, label and vector) is one anchor; a null id is no anchor, and comes last in ties;
anchors without positives or without negatives in a band give no row, so an empty table gives an
empty result. Other columns are not read. Scores are 64-bit integers, which the components
(already scaled and floored) must leave room for.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.words import rows as batch_rows
from skyledger.session import cut

#: Subset sums of eight components: the bits of every byte.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def subset_tables(vectors: np.ndarray) -> np.ndarray:
    """(group, 256, anchor): the sum of every subset of each group of eight components."""
    count, width = vectors.shape
    groups = -(-width // 8)
    padded = np.zeros((count, groups * 8), np.int64)
    padded[:, :width] = vectors
    return np.stack([BITS @ padded[:, 8 * g : 8 * g + 8].T for g in range(groups)]) if groups else np.zeros((0, 256, count), np.int64)


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """(plane, group, row) bytes of two's complement components, lowest plane first."""
    count, width = vectors.shape
    groups = -(-width // 8)
    padded = np.zeros((count, groups * 8), np.int64)
    padded[:, :width] = vectors
    top = int(max(padded.max(initial=0), -1 - padded.min(initial=0)))
    planes = top.bit_length() + 1
    bits = (padded[None] >> np.arange(planes)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1).copy()


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(row, anchor) inner products by look-ups, shifts and additions."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    shared = min(len(tables), planes.shape[1])
    for p in reversed(range(len(planes))):
        total <<= 1
        for g in range(shared):
            part = tables[g][planes[p, g]]
            if p == len(planes) - 1:
                total -= part
            else:
                total += part
    return total


def usable(label: str, vector: str) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & sound


# ---- packing


_SLAB = pa.schema([("slab", pa.string()), ("ids", pa.binary()), ("known", pa.binary()), ("labels", pa.binary()), ("count", pa.int32()),
                   ("planes", pa.int32()), ("bits", pa.binary())])
_SLAB_SQL = "slab string, ids binary, known binary, labels binary, count int, planes int, bits binary"


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    sizes = np.asarray(lists.value_lengths(), np.int64)
    flat = np.asarray(lists.flatten(), np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def _pack(slab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slab):
                part = batch.slice(at, slab)
                bits = bit_planes(_matrix(part["vector"]))
                ids = part["id"]
                one = (uuid.uuid4().hex, np.asarray(ids.fill_null(0), np.int64).tobytes(), np.asarray(ids.is_valid()).astype(np.uint8).tobytes(),
                       np.asarray(part["label"], np.int64).tobytes(), part.num_rows, len(bits), bits.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one, _SLAB, strict=True)], schema=_SLAB)
    return run


# ---- cells


_BEST = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_BEST_SQL = "anchor bigint, place int, id bigint, score bigint"


class Best:
    """The best rows so far of one anchor and band."""

    def __init__(self, keep: int):
        self.keep = keep
        self.score, self.known, self.id = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def floor(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.keep else None

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        score, known, ids = np.append(self.score, score), np.append(self.known, known), np.append(self.id, ids)
        order = np.lexsort((ids, ~known, -score))[: self.keep]
        self.score, self.known, self.id = score[order], known[order], ids[order]


def _cells(keep: int, step: int = 64):
    """The best rows of every anchor and place (band); a cell's anchors come first, then its slabs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors = None, []

        def done():
            out = ([], [], [], [])
            for key, _, _, _, bands, best in anchors:
                for (place, _, _), held in zip(bands, best, strict=True):
                    for score, known, i in zip(held.score, held.known, held.id, strict=True):
                        for column, value in zip(out, (key, place, int(i) if known else None, int(score)), strict=True):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _BEST, strict=True)], schema=_BEST)

        def meet(ids, known, labels, planes):
            reach = float(1 << len(planes)) * 8 * planes.shape[1]
            for at in range(0, len(anchors), step):
                part = anchors[at : at + step]
                width = max(len(a[3]) for a in part)
                vectors = np.zeros((len(part), width), np.int64)
                for row, a in zip(vectors, part, strict=True):
                    row[: len(a[3])] = a[3]
                kind = np.int32 if np.abs(vectors).max(initial=0) * reach < 2**30 else np.int64
                tables = subset_tables(vectors).astype(kind)
                for lo in range(0, len(ids), 4096):
                    some = slice(lo, lo + 4096)
                    every = scores(tables, planes[:, :, some])
                    for k, (_, own, label, _, bands, best) in enumerate(part):
                        mine = every[:, k]
                        alike = labels[some] == label
                        for (place, low, high), held in zip(bands, best, strict=True):
                            fits = alike & ~(known[some] & (ids[some] == own)) if place < 0 else ~alike & (mine >= low) & (mine <= high)
                            if (floor := held.floor()) is not None:
                                fits &= mine >= floor
                            if len(at_ := np.nonzero(fits)[0]):
                                held.add(mine[at_].astype(np.int64), known[some][at_], ids[some][at_])

        for batch in batches:
            for block, part, key, own, label, vector, bands, ids, known, labels, count, planes, bits in batch_rows(batch, 8):
                if (block, part) != cell:
                    if anchors:
                        yield done()
                    cell, anchors = (block, part), []
                if key is not None:
                    bounds = [(-1, 0, 0)] if bands is None else [(b["place"], b["low"], b["high"]) for b in bands]
                    anchors.append((key, own, label, np.array(vector, np.int64), bounds, [Best(keep) for _ in bounds]))
                elif anchors:
                    held = np.frombuffer(bits, np.uint8).reshape(planes, -1, count) if count and bits else np.zeros((planes, 0, count), np.uint8)
                    meet(np.frombuffer(ids, np.int64), np.frombuffer(known, np.uint8).astype(bool), np.frombuffer(labels, np.int64), held)
        if anchors:
            yield done()
    return run


def _best(anchors: DataFrame, slabs: DataFrame, blocks: int, parts: int, keep: int) -> DataFrame:
    """(anchor, place, id, score): the ``keep`` first rows of each anchor and band over all cells."""
    where = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int")
    left = anchors.select(where.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "key", "own", "label", "vector", "bands",
                          *[F.lit(None).cast(t).alias(n) for n, t in (("ids", "binary"), ("known", "binary"), ("labels", "binary"), ("count", "int"), ("planes", "int"), ("bits", "binary"))])
    part = F.pmod(F.xxhash64("slab"), F.lit(parts)).cast("int")
    right = slabs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"),
                         *[F.lit(None).cast(dict(anchors.dtypes)[n]).alias(n) for n in ("key", "own", "label", "vector", "bands")],
                         "ids", "known", "labels", "count", "planes", "bits")
    cells = left.unionAll(right).withColumn("_last", F.col("key").isNull())
    cells = cells.repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "_last").drop("_last")
    found = cells.mapInArrow(_cells(keep), _BEST_SQL)
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep)


def mine_negatives(rows: DataFrame, anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, parts: int = 64, slab: int = 8192,
                   block: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that ``anchor`` marks.

    A negative lies within ``low`` to ``high`` hundredths of its positive's score. ``parts`` and
    ``block`` only set the grid of cells: parts of the slabs, and anchors of a block.
    """
    whole = rows.where(usable(label, vector)).select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale))).alias("vector"),
        (F.coalesce(anchor, F.lit(False)) & F.col(id_column).isNotNull()).alias("_anchor"))
    slabs = cut(whole.select("id", "label", "vector").mapInArrow(_pack(slab), _SLAB_SQL))
    anchors = cut(whole.where("_anchor").select("id", "label", "vector").distinct().select(
        F.xxhash64("id", "label", "vector").alias("key"), F.col("id").alias("own"), "label", "vector"))
    blocks = max(1, -(-anchors.count() // block))
    bands = "array<struct<place:int,low:bigint,high:bigint>>"
    nearest = cut(_best(anchors.withColumn("bands", F.lit(None).cast(bands)), slabs, blocks, parts, positives).select(
        "anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * p <= 100 * s <= high * p, in whole numbers
    bounds = nearest.groupBy(F.col("anchor").alias("key")).agg(F.collect_list(F.struct(
        "place", F.expr(f"-((-({low} * positive_score) - pmod(-({low} * positive_score), 100)) div 100)").alias("low"),
        F.expr(f"(({high} * positive_score) - pmod({high} * positive_score, 100)) div 100").alias("high"))).alias("bands"))
    asking = anchors.join(bounds.select("key", F.col("bands").cast(bands).alias("bands")), "key")
    found = _best(asking, slabs, blocks, parts, negatives).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(nearest, ["anchor", "place"]).join(anchors.select(F.col("key").alias("anchor"), F.col("own").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
