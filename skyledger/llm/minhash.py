"""MinHash near-duplicates with sequential Bayesian verification.

1. *Signatures.* The smallest values of ``bands * width`` hashes over a document's word shingles.
   Equal sets are one node, represented by their smallest doc_id.
2. *Bands.* Nodes with equal values in all places of a band are candidates; the nodes of one band
   value are a cell. With 32 bands of 5 a pair at similarity 0.8 has no cell in common with
   probability 3e-6, and less above it.
3. *Bayesian verification* (Satuluri and Parthasarathy 2012). The matching places of a pair are
   counted batch by batch. After n places with m matches the similarity has, from a uniform prior,
   the posterior Beta(m + 1, n - m + 1); a pair is pruned as soon as the probability that it reaches
   ``share`` is below ``miss``. The least m of each batch is tabulated once.
4. Pairs that pass every batch are compared exactly on their full shingle sets.
5. Cells are contracted by rounds of pivots (``cells``): only nodes of other components meet a
   pivot. What still spans components after the rounds is compared inside tasks, every pair of
   different components, again by batches and exactly; large cells are cut into blocks, each with
   each. No pairs are emitted but links, and no cell is cut off.

The result is the component of each document; links are exact, and one is lost only by chance of
bands (3e-6) or by the chosen miss probability.

Defined cases: a null or wordless text has the empty set, is linked with nothing and is kept; a
text of fewer words than a shingle is one shingle; equal texts and repeated rows are linked; rows
that share a doc_id are one document; a null doc_id keeps its row, with a null component, and is
kept; the empty table gives an empty result; texts of any length are read whole; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.cells import blocked, members_of, once, pivot_rounds
from skyledger.llm.words import lowered_words, rows, scramble, shingle_set
from skyledger.session import cut, packed

BANDS, WIDTH = 32, 5
#: Places compared between two looks at the posterior.
BATCH = 32


def permutations(count: int, seed: int = 1) -> np.ndarray:
    """Odd multipliers and offsets of ``count`` hashes, the same on every machine."""
    base = scramble(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return np.stack([base[:count] | np.uint64(1), base[count:]])


def signature(elements: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The smallest upper half of every hash over ``elements``."""
    out = np.full(hashes.shape[1], np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), 2048):
            part = scramble(elements[at : at + 2048])[:, None] * hashes[0] + hashes[1]
            np.minimum(out, (part >> np.uint64(32)).min(0).astype(np.uint32), out=out)
    return out


def least_matches(share: Fraction, places: int, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n places a pair with fewer than m matches is pruned.

    From a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    t, out = float(share), []
    for n in [*range(BATCH, places, BATCH), places]:
        below = 0.0
        for m in range(n + 1):
            below += np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t)) if t < 1 else 0.0
            if below >= miss:
                break
        out.append((n, m))
    return out


def plausible(one: np.ndarray, others: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Places of the rows of ``others`` that no batch prunes; ``one`` may be a row for each."""
    alive, matches, done = np.arange(len(others)), np.zeros(len(others), np.int64), 0
    for n, least in bounds:
        if not len(alive):
            break
        mine = one[alive, done:n] if one.ndim == 2 else one[done:n]
        matches = matches + (others[alive, done:n] == mine).sum(1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def alike(a: np.ndarray, b: np.ndarray, share: Fraction) -> bool:
    """``|A & B| >= share * |A | B|`` of two sorted sets."""
    if min(len(a), len(b)) * share.denominator < max(len(a), len(b)) * share.numerator:
        return False
    union = len(np.union1d(a, b))
    return (len(a) + len(b) - union) * share.denominator >= union * share.numerator


_DESCRIBED = pa.schema([("_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _describe(size: int, bands: int, width: int):
    hashes = permutations(bands * width)
    turn = permutations(bands, seed=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = {f.name: [] for f in _DESCRIBED}
                for doc_id, text in rows(batch.slice(at, 1024)):
                    elements = shingle_set(lowered_words(text), size)
                    sig, keys, digest = b"", [], (0, 0)
                    if len(elements):
                        least = signature(elements, hashes)
                        sig = least.tobytes()
                        with np.errstate(over="ignore"):
                            key = turn[1].copy()
                            for column in least.reshape(bands, width).T.astype(np.uint64):
                                key = scramble((key ^ column) * turn[0])
                            digest = tuple(int(scramble(elements ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (11, 23))
                        keys = key.view(np.int64)
                    for name, value in zip(_DESCRIBED.names, (doc_id, len(elements), *digest, sig, keys), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _DESCRIBED], schema=_DESCRIBED)
    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _prune(bounds: list[tuple[int, int]]):
    """The pairs whose signatures pass every batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                one, two = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint32).reshape(part.num_rows, -1) for c in ("sig", "_sig"))
                alive = pa.array(plausible(one, two, bounds))
                yield pa.RecordBatch.from_arrays([part["a"].take(alive), part["b"].take(alive)], schema=_PAIR)
    return run


def _verify(share: Fraction, size: int):
    """The pairs whose full sets are alike; a pivot's pairs follow each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, np.empty(0, np.uint64)  # the pivot's text and set
        for batch in batches:
            a, b = [], []
            for node, other, text, its in rows(batch, 256):
                if its != pivot:
                    pivot, held = its, shingle_set(lowered_words(its), size)
                if alike(shingle_set(lowered_words(text), size), held, share):
                    a.append(node), b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)
    return run


def _leaves(share: Fraction, size: int, bounds: list[tuple[int, int]]):
    """Links that join what the rows of a region have in different components; one region is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done():
            ids, owner, sigs, comps, texts = zip(*held, strict=True)
            every = np.frombuffer(b"".join(sigs), np.uint32).reshape(len(ids), -1)
            label = np.unique(np.array(comps, np.int64), return_inverse=True)[1]
            sets: dict[int, np.ndarray] = {}
            a, b = [], []

            def elements(i):
                if i not in sets:
                    sets[i] = shingle_set(lowered_words(texts[i]), size)
                return sets[i]

            mine = np.array(owner, bool)
            order = np.array(ids, np.int64)
            for i in np.nonzero(mine)[0]:
                others = np.nonzero((label != label[i]) & (order != order[i]) & (~mine | (order > order[i])))[0]
                for j in others[plausible(every[i], every[others], bounds)]:
                    if label[i] != label[j] and alike(elements(i), elements(j), share):
                        a.append(ids[i]), b.append(ids[j])
                        label[label == label[j]] = label[i]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)

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


def near_duplicates(docs: DataFrame, size: int = 4, share: Fraction = Fraction(4, 5), bands: int = BANDS, width: int = WIDTH, miss: float = 1e-9,
                    leaf_rows: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its smallest doc_id) and kept (it is the component's representative)."""
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    described = cut(texts.mapInArrow(_describe(size, bands, width), "_id bigint, n bigint, d1 bigint, d2 bigint, sig binary, keys array<bigint>"))
    full = described.where("n > 0 and _id is not null")
    nodes = cut(full.groupBy("n", "d1", "d2").agg(F.min("_id").alias("node")))
    classes = nodes.select(F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "node")
    same = (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))
    members = cut(described.select("_id", "n", "d1", "d2").join(classes, same, "left").select("_id", "n", "node"))
    owners = members.where("node is not null").select("_id", "node").distinct()
    # a node's own row is one of those with its doc_id; rows that share that id are one document
    first = nodes.select(F.col("node").alias("_id")).distinct()
    held = full.join(first, "_id").select("_id", "sig", "keys")
    # only band values that several nodes have
    banded = held.select(F.explode("keys").alias("key"), F.col("_id").alias("node"))
    shared = banded.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select("key")
    cells = packed(banded.join(shared, "key").distinct())
    # signatures and texts of nodes with a candidate, which every round sends again
    wanted = cells.select(F.col("node").alias("_id")).distinct()
    held, texts = cut(held.select("_id", "sig").join(wanted, "_id")), cut(texts.join(wanted, "_id"))
    bounds = least_matches(share, bands * width, miss)

    def meet(pairs: DataFrame) -> DataFrame:
        one, two = held.select(F.col("_id").alias("a"), "sig"), held.select(F.col("_id").alias("b"), F.col("sig").alias("_sig"))
        passed = packed(pairs.join(one, "a").join(two, "b").select("a", "b", "sig", "_sig").mapInArrow(_prune(bounds), "a bigint, b bigint").distinct())
        mine, its = texts.select(F.col("_id").alias("a"), F.col("_text").alias("_mine")), texts.select(F.col("_id").alias("b"), "_text")
        return passed.join(mine, "a").join(its, "b").select("a", "b", "_mine", "_text").mapInArrow(_verify(share, size), "a bigint, b bigint").distinct()

    links, left = pivot_rounds(cells, meet)
    several = owners.groupBy("_id").agg(F.min("node").alias("b"), F.max("node").alias("_last")).where("b < _last").select("_id", "b")
    every = owners.join(several, "_id").where("node <> b").select(F.col("node").alias("a"), "b")
    if links is not None:
        every = every.unionAll(links)
    if not left.isEmpty():
        known = members_of(links).withColumnsRenamed({"node": "_id", "comp": "_comp"}) if links is not None else None
        rest = blocked(once(left).withColumn("owner", F.lit(True)), leaf_rows)
        rest = rest.withColumn("comp", F.col("_id")) if known is None else rest.join(known, "_id", "left").withColumn("comp", F.coalesce("_comp", "_id"))
        placed = rest.join(held.select("_id", "sig"), "_id").join(texts, "_id").repartition("region").sortWithinPartitions("region", "_id")
        every = every.unionAll(placed.select("region", "_id", "owner", "sig", "comp", "_text").mapInArrow(_leaves(share, size, bounds), "a bigint, b bigint"))
    comps = members_of(cut(every.distinct()))
    component = F.when(F.col("_id").isNotNull(), F.coalesce("comp", "node", "_id"))
    return members.join(comps, "node", "left").select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("_id").isNull() | (F.col("_id") == component)).alias("kept"))
