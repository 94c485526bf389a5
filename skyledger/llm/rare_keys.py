"""Keys that two similar sets share: the rarest elements of each set, by counts over the whole table.

Two sets with ``|A & B| >= share * |A | B|`` have ``ceil(share * n)`` elements or more in common,
so under any order of the elements, the same for all sets, the first
``n - ceil(share * n) + 1`` elements of both hold a common one. The order taken here is: elements
whose hash is below a fixed bound, by the number of sets that hold them and then by hash; then
all others, by hash. Rare elements come first, so what few sets share decides, and a passage of a
thousand documents hardly ever does.

*Position bound.* Let c elements be in both prefixes. Of the two sets take the one whose prefix ends
first in the order: what its prefix shares with the other set lies in the other's prefix too, so the
intersection is c and no more than its ``n - prefix`` further elements.

Only elements below the bound are counted. A chunk of documents sends its distinct ones once,
with their counts (so a very common element is one entry of a chunk), packed by range of hash; a
range adds up and answers each chunk with those that more than one set holds. A set whose unique
elements fill its prefix has no partner and gives no key at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import lowered_words, rows, scramble, shingle_set
from skyledger.session import cut

#: Counted elements of a chunk, about.
CHUNK = 1 << 17
#: Part of the hash space that is counted, as a multiple of the part that a prefix takes.
SPARE = 2.0


def prefix_length(n: int, share: Fraction) -> int:
    return n - -(-n * share.numerator // share.denominator) + 1 if n else 0


def overlap_needed(n, m, share: Fraction):
    """Smallest intersection of linked sets of n and m elements: i >= share * (n + m - i)."""
    return -(-(n + m) * share.numerator // (share.numerator + share.denominator))


def bound(share: Fraction) -> int:
    """Hashes below it are counted."""
    return min((1 << 64) - 1, int(float(1 - share) * SPARE * 2**64))


def digests(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    if not len(elements):
        return 0, 0
    with np.errstate(over="ignore"):
        return tuple(int(scramble(elements ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (11, 23))


_CHUNK = pa.schema([
    ("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("d1", pa.list_(pa.int64())), ("d2", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("low", pa.binary()), ("extra_counts", pa.list_(pa.int64())), ("extra", pa.binary()),
])
_CHUNK_SQL = ("chunk string, ids array<bigint>, n array<bigint>, d1 array<bigint>, d2 array<bigint>, counts array<bigint>, low binary, "
              "extra_counts array<bigint>, extra binary")


def _chunks(share: Fraction, size: int):
    limit = np.uint64(bound(share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        seen: set = set()
        weight = 0

        def clear():
            nonlocal weight
            held.update({k: [] for k in ("ids", "n", "d1", "d2", "counts", "low", "extra_counts", "extra")})
            seen.clear()
            weight = 0

        def done():
            packed = {k: (np.concatenate(held[k]) if held[k] else np.empty(0, np.uint64)).tobytes() for k in ("low", "extra")}
            one = {"chunk": uuid.uuid4().hex, **held, **packed}
            out = pa.RecordBatch.from_arrays([pa.array([one[f.name]], f.type) for f in _CHUNK], schema=_CHUNK)
            clear()
            return out

        clear()
        for batch in batches:
            for doc_id, text in rows(batch):
                elements = shingle_set(lowered_words(text), size)
                n, key = len(elements), digests(elements)
                low = extra = np.empty(0, np.uint64)
                if n and doc_id is not None and (n, *key) not in seen:
                    seen.add((n, *key))
                    order = np.sort(scramble(elements))
                    at = int(np.searchsorted(order, limit))
                    low, extra = order[:at], order[at : max(at, prefix_length(n, share))]
                for name, value in (("ids", doc_id), ("n", n), ("d1", key[0]), ("d2", key[1]), ("counts", len(low)), ("low", low),
                                    ("extra_counts", len(extra)), ("extra", extra)):
                    held[name].append(value)
                weight += len(low) + 64
                if weight >= CHUNK:
                    yield done()
        if held["ids"]:
            yield done()
    return run


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("hashes", pa.binary()), ("times", pa.binary())])


def _send(share: Fraction, buckets: int):
    width = np.uint64(bound(share) // buckets + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, low in rows(batch, 8):
                hashes, times = np.unique(np.frombuffer(low, np.uint64), return_counts=True)
                if not len(hashes):
                    continue
                at = (hashes // width).astype(np.int32)
                start = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
                ends = np.append(start[1:], len(at))
                times = times.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(at[start], pa.int32()), pa.array([chunk] * len(start), pa.string()),
                    pa.array([hashes[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()),
                    pa.array([times[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary())], schema=_SENT)
    return run


_ANSWER = pa.schema([("chunk", pa.string()), ("hashes", pa.binary()), ("totals", pa.binary())])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, to each chunk: its hashes that two sets or more hold, with their numbers. One bucket is held at a time."""
    bucket, chunks, parts, times = None, [], [], []

    def done():
        ends = np.cumsum([len(p) for p in parts])
        every, spot = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(spot, np.concatenate(times), len(every)).astype(np.int64)[spot]
        found = ([], [], [])
        for chunk, lo, hi in zip(chunks, np.append(0, ends[:-1]), ends, strict=True):
            mine, total = every[spot[lo:hi]], totals[lo:hi]
            if (keep := total > 1).any():
                for column, value in zip(found, (chunk, mine[keep].tobytes(), total[keep].tobytes()), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _ANSWER, strict=True)], schema=_ANSWER)

    for batch in batches:
        for b, chunk, hashes, counts in rows(batch, 64):
            if b != bucket and parts:
                yield done()
                chunks, parts, times = [], [], []
            bucket = b
            chunks.append(chunk), parts.append(np.frombuffer(hashes, np.uint64)), times.append(np.frombuffer(counts, np.uint32))
    if parts:
        yield done()


_KEYS = pa.schema([("_id", pa.int64()), ("key", pa.int64())])


def _choose(share: Fraction):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        joined = [b"".join(right[c].to_pylist()) for c in ("hashes", "totals")]
        shared, totals = np.frombuffer(joined[0], np.uint64), np.frombuffer(joined[1], np.int64)
        order = np.argsort(shared, kind="stable")
        shared, totals = shared[order], totals[order]
        ids, keys = [], []
        for one in left.to_pylist():
            low, extra = np.frombuffer(one["low"], np.uint64), np.frombuffer(one["extra"], np.uint64)
            at = np.minimum(np.searchsorted(shared, low), max(len(shared) - 1, 0))
            hit = shared[at] == low if len(shared) else np.zeros(len(low), bool)
            a = b = 0
            for doc_id, n, count, more in zip(one["ids"], one["n"], one["counts"], one["extra_counts"], strict=True):
                mine = hit[a : a + count]
                left_over = prefix_length(n, share) - (count - int(mine.sum())) if count + more else 0
                if left_over > 0:
                    held, number = low[a : a + count][mine], totals[at[a : a + count][mine]]
                    chosen = np.concatenate([held[np.lexsort((held, number))[:left_over]], extra[b : b + more]])
                    ids.append(np.full(len(chosen), doc_id, np.int64)), keys.append(chosen.view(np.int64))
                a, b = a + count, b + more
        return pa.table([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in (ids, keys)], schema=_KEYS)
    return run


def describe_sets(texts: DataFrame, share: Fraction, size: int, bucket_elements: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """For ``texts(_id, _text)``: (_id, n, d1, d2) of each row, and (_id, key) of the sets that may have a partner."""
    chunks = cut(texts.select("_id", "_text").mapInArrow(_chunks(share, size), _CHUNK_SQL))
    described = chunks.select(F.explode(F.arrays_zip("ids", "n", "d1", "d2")).alias("r")).select(F.col("r.ids").alias("_id"), "r.n", "r.d1", "r.d2")
    total = (chunks.agg(F.sum(F.octet_length("low"))).first()[0] or 0) // 8
    buckets = int(max(32, -(-total // bucket_elements)))
    sent = chunks.select("chunk", "low").mapInArrow(_send(share, buckets), "bucket int, chunk string, hashes binary, times binary")
    answers = sent.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "chunk string, hashes binary, totals binary")
    asking = chunks.where(F.octet_length("low") + F.octet_length("extra") > 0).select("chunk", "ids", "n", "counts", "low", "extra_counts", "extra")
    keys = asking.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_choose(share), "_id bigint, key bigint")
    return described, keys
