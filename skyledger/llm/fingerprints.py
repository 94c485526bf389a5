"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs at line ends, long lines further at the ends of their sentences,
and long sentences every 64 characters, so that texts of one paragraph can be alike in part. A paragraph's 64-bit digest (with its number among equal ones, so repeats count) goes
into three cells of a table; a cell holds a count, the XOR of its digests and the XOR of their
checks. Tables of equal size are subtracted cell by cell; peeling cells that hold one digest
recovers the digests that differ. When peeling fails, both tables are made again twice as large.
The likeness of two texts is the Jaccard similarity of their digest sets: with sizes n and m and
d differing digests, ``(n + m - d) / (n + m + d)``.

Each text is compared with an edited version and with the next text by descending doc_id. Texts
are dealt to ranges of doc_id and read in order, one behind the other; the first text of a range
is sent to the range above as well, so nothing else crosses ranges.

Defined cases: a null text is the empty text, whose table is empty (two empty texts have likeness
1); equal texts have equal fingerprints; rows that share a doc_id follow each other by text
hash; a null doc_id comes last; the single row of a table is its own next; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import rows, scramble

#: Cells of the published fingerprint, a multiple of 3.
CELLS = 30
PARAGRAPH = re.compile(r"[^\n.!?]{0,64}[.!?]+|[^\n.!?]{1,64}")


def paragraph_digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs; the k-th of equal ones is numbered k."""
    parts = [p.strip() for p in PARAGRAPH.findall(text)]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [p.encode("utf-8", "surrogatepass") for p in parts if p]), np.uint64)
    if not len(hashes):
        return hashes
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    number = np.arange(len(ranked)) - np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0))
    with np.errstate(over="ignore"):
        return scramble(ranked + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _places(digests: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of each digest, one in each third of the table."""
    third = cells // 3
    with np.errstate(over="ignore"):
        return np.stack([(scramble(digests + np.uint64(k + 1)) % np.uint64(third)).astype(np.int64) + k * third for k in range(3)])


def tables(groups: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, keys, checks) of each group's table."""
    flat = np.concatenate(groups) if groups else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(groups)), [len(g) for g in groups]) * cells
    counts, keys, checks = np.zeros(len(groups) * cells, np.int64), np.zeros(len(groups) * cells, np.uint64), np.zeros(len(groups) * cells, np.uint64)
    check = _check(flat)
    for place in _places(flat, cells):
        counts += np.bincount(row + place, minlength=len(counts))
        np.bitwise_xor.at(keys, row + place, flat)
        np.bitwise_xor.at(checks, row + place, check)
    shape = (len(groups), cells)
    return counts.reshape(shape), keys.reshape(shape), checks.reshape(shape)


def _check(digests: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scramble(digests ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)


def peel(counts: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, digests, signs, failed) of differences of tables; the arrays given are used up."""
    n, cells = counts.shape
    out_row, out_key, out_sign = [], [], []
    active = np.arange(n)
    for _ in range(cells * 2):
        single = (np.abs(counts[active]) == 1) & (_check(keys[active]) == checks[active])
        r, c = np.nonzero(single)
        if not len(r):
            break
        r = active[r]
        found = keys[r, c]
        pair = np.stack([r.astype(np.uint64), found], 1)
        _, keep = np.unique(pair, axis=0, return_index=True)  # a digest may be alone in two of its cells
        r, found, sign = r[keep], found[keep], counts[r[keep], c[keep]]
        out_row.append(r), out_key.append(found), out_sign.append(sign)
        check = _check(found)
        for place in _places(found, cells):
            np.subtract.at(counts, (r, place), sign)
            np.bitwise_xor.at(keys, (r, place), found)
            np.bitwise_xor.at(checks, (r, place), check)
        active = np.unique(r)
    failed = (counts != 0).any(1) | (keys != 0).any(1)
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(out_row, np.int64), join(out_key, np.uint64), join(out_sign, np.int64), failed


def differences(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS, made=None) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """([digests only left, only right] of each pair, cells that it took), doubling the tables of failed pairs.

    ``made`` are tables of ``cells`` cells that are there already, for both sides.
    """
    result: list = [None] * len(left)
    used = [0] * len(left)
    pending = np.arange(len(left))
    while len(pending):
        a, b = made or (tables([left[i] for i in pending], cells), tables([right[i] for i in pending], cells))
        made = None
        r, k, s, failed = peel(a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2])
        order = np.argsort(r, kind="stable")
        r, k, s = r[order], k[order], s[order]
        edges = np.searchsorted(r, np.arange(len(pending) + 1))
        for j, i in enumerate(pending):
            if not failed[j]:
                mine = slice(edges[j], edges[j + 1])
                result[i] = (k[mine][s[mine] > 0], k[mine][s[mine] < 0])
                used[i] = cells
        pending = pending[failed]
        cells *= 2
    return result, used


def likeness(n: int, m: int, differ: int) -> float:
    return 1.0 if n + m == 0 else round((n + m - differ) / (n + m + differ), 6)


def fingerprint_text(counts: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> str:
    """A table as text: 4 + 8 + 4 little-endian bytes a cell, in base64."""
    return base64.b64encode(counts.astype("<i4").tobytes() + keys.astype("<u8").tobytes() + checks.astype("<u4").tobytes()).decode()


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_removed", pa.int64()), ("n_added", pa.int64()), ("cells", pa.int64())])
_OUT_SQL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
            "near_next double, n_removed bigint, n_added bigint, cells bigint")


def _compare(block: list[tuple]) -> pa.RecordBatch:
    """``block`` holds (doc_id, text) and the row after the last one to report."""
    texts = [t for _, t in block]
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts[:-1], texts[1:], strict=True)]
    own, changed = [paragraph_digests(t) for t in texts], [paragraph_digests(t) for t in edited]
    n = len(edited)
    mine, other = tables(own, CELLS), tables(changed, CELLS)
    to_edited, cells = differences(own[:-1], changed, made=(tuple(x[:-1] for x in mine), other))
    to_next, _ = differences(own[:-1], own[1:], made=(tuple(x[:-1] for x in mine), tuple(x[1:] for x in mine)))
    values = {
        "doc_id": [d for d, _ in block[:-1]], "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [fingerprint_text(*(x[i] for x in mine)) for i in range(n)],
        "edited_fingerprint": [fingerprint_text(*(x[i] for x in other)) for i in range(n)],
        "near_edited": [likeness(len(own[i]), len(changed[i]), len(to_edited[i][0]) + len(to_edited[i][1])) for i in range(n)],
        "near_next": [likeness(len(own[i]), len(own[i + 1]), len(to_next[i][0]) + len(to_next[i][1])) for i in range(n)],
        "n_removed": [len(x[0]) for x in to_edited], "n_added": [len(x[1]) for x in to_edited], "cells": cells}
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in _OUT], schema=_OUT)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, guest, doc_id descending); a range's guest is the first text of the range below."""
    held, current, size, closed = [], None, 0, False
    for batch in batches:
        for bucket, guest, doc_id, _, text in rows(batch, 256):
            if bucket != current:
                held, current, size, closed = [], bucket, 0, False
            if closed:
                continue
            held.append((doc_id, text or ""))
            size += len(text or "")
            if len(held) > 1 and (guest or size > 500_000 or len(held) > 256):
                yield _compare(held)
                held, size, closed = held[-1:], 0, guest


def _place(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Range of each id: 0 for the largest; null ids are in the last one."""
    values = ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    return len(bounds) - np.searchsorted(bounds, values, side="right")


_RANGED = "b int, guest boolean, _id bigint, _tie bigint, _text string"


def _heads(bounds: np.ndarray):
    """The rows of each batch that may be the first of their range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = pa.array(_place(batch["_id"], bounds), pa.int32())
                yield pa.RecordBatch.from_arrays([at, batch["_id"], batch["_tie"]], names=["b", "_id", "_tie"])
    return run


def _deal(bounds: np.ndarray, firsts: dict[int, tuple], above: dict[int, int]):
    """Every row to its range; the first row of a range to the range above as well, as its guest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _place(batch["_id"], bounds)
            key = list(zip(at.tolist(), batch["_id"].to_pylist(), batch["_tie"].to_pylist(), strict=True))
            lead = [i for i, (b, doc_id, tie) in enumerate(key) if firsts.get(b) == (doc_id, tie)]
            take = pa.array(list(range(len(key))) + lead, pa.int64())
            place = pa.array(at.tolist() + [above[key[i][0]] for i in lead], pa.int32())
            guest = pa.array([False] * len(key) + [True] * len(lead))
            yield pa.RecordBatch.from_arrays([place, guest, *[batch[c].take(take) for c in ("_id", "_tie", "_text")]],
                                             names=["b", "guest", "_id", "_tie", "_text"])
    return run


def compare_versions(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint, the edited text's, and both likenesses.

    There are three ranges to a shuffle partition, bounded by quantiles of doc_id; the driver
    gets the bounds and the first row of each range, whose number that setting fixes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_tie"), F.col("text").alias("_text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = 3 * parts
    marks = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 20_000)).first()[0] or []
    bounds = np.array(sorted(set(marks)), np.int64)
    falling = F.col("_id").desc_nulls_last()
    heads = texts.select("_id", "_tie").mapInArrow(_heads(bounds), "b int, _id bigint, _tie bigint")
    order = F.struct(F.col("_id").isNull().alias("z"), (-F.coalesce("_id", F.lit(0)).cast("decimal(20,0)")).alias("k"), "_tie", "_id")
    firsts = {r["b"]: (r["h"]["_id"], r["h"]["_tie"]) for r in heads.groupBy("b").agg(F.min(order).alias("h")).collect()}
    places = sorted(firsts)
    above = {b: places[i - 1] for i, b in enumerate(places)}  # the largest id follows the smallest
    dealt = texts.mapInArrow(_deal(bounds, firsts, above), _RANGED)
    ordered = dealt.repartition(parts, "b").sortWithinPartitions("b", "guest", falling, "_tie")
    return ordered.mapInArrow(_in_order, _OUT_SQL)
