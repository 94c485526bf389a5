"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

Each task rolls a polynomial hash over the words of its documents and sends, for each chunk of
documents and each bucket of the hash space, the chunk's distinct hashes in one packed row,
with the places where they start; a hash that repeats inside the chunk is marked, so a hot
window costs one entry a chunk. A bucket's rows are merged in one sort, and each row answers
with the places whose hash also starts elsewhere. Per chunk the places become maximal intervals
of words to remove, and the text is cut once, where it is read again.

A chunk is what a task read, so ``docs`` must be a table (a scan, a checkpoint), whose rows come
in the same order when a lost task is repeated.

Hashes are 64 bits wide over 64-bit word hashes: two different windows share one with
probability 5e-20, 0.0004 expected false repeats in 10**8 windows. A bucket holds some
``bucket_mb`` of text, so the number of buckets follows the input; rows hold at most
``ROW`` hashes.

Defined cases: null and wordless texts have no words and become the empty text; texts of fewer
words than the window stay; repeated rows (also of one doc_id) count as other places, so all
lose the passage; rows are told apart by (doc_id, text hash); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import rows, scramble, word_hashes

#: Multiplier of the rolling polynomial, odd.
BASE = 0x5851F42D4C957F2D
#: Windows of a chunk after which it is sent off.
CHUNK = 1_000_000
ROW = 32_768


def raw_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each window of ``width`` values, modulo 2**64.

    With P the prefix sums of ``value[i] * BASE**i``, a window is ``(P[i + width] - P[i]) / BASE**i``;
    BASE is odd, so the division is a product with the inverse power.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, BASE, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(scramble(hashes) * up)])
        return scramble((sums[width:] - sums[: n - width + 1]) * down[: n - width + 1])


_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("part", pa.int32()),
                   ("hashes", pa.binary()), ("places", pa.binary()), ("ids", pa.list_(pa.int64())),
                   ("texts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_SENT_SQL = "kind int, bucket bigint, chunk bigint, part int, hashes binary, places binary, ids array<bigint>, texts array<bigint>, counts array<bigint>"


def _packed(places: np.ndarray) -> bytes:
    """Ascending places as gaps of one byte; a byte of 255 means that the gap goes on in the next."""
    gaps = np.diff(places, prepend=0)
    ends = np.cumsum(gaps // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 255, np.uint8)
    out[ends] = gaps % 255
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def _send(width: int, buckets: int):
    """Rows of kind 0: hashes in order of their places, for a bucket; kind 1: the documents of a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId() << 32, 0
        ids, texts, counts, windows, held = [], [], [], [], 0

        def flush():
            nonlocal serial, ids, texts, counts, windows, held
            chunk, serial = task + serial, serial + 1
            out = {f.name: [] for f in _SENT}

            def add(kind, bucket, part, hashes, places, *lists):
                for name, value in zip(_SENT.names, (kind, bucket, chunk, part, hashes, places, *lists), strict=True):
                    out[name].append(value)

            add(1, int(chunk % buckets), 0, None, None, ids, texts, counts)
            flat = np.concatenate(windows) if windows else np.empty(0, np.uint64)
            values, first, n = np.unique(flat, return_index=True, return_counts=True)
            if len(values) < len(flat):  # a hash that repeats in the chunk is sent once; its places are known to repeat
                again = np.isin(flat, values[n > 1])
                for at, part in enumerate(np.array_split(np.nonzero(again)[0], max(1, int(again.sum()) // ROW))):
                    add(2, int((chunk + at) % buckets), at, None, _packed(part), None, None, None)
            once = np.zeros(len(flat), bool)
            once[first] = True
            place = np.nonzero(once)[0]
            bucket = ((flat[place] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place, bucket = place[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1)) if buckets < len(bucket) else np.append(np.nonzero(np.diff(bucket, prepend=-1))[0], len(bucket))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for at in range(int(lo), int(hi), ROW):
                    part = place[at : min(at + ROW, int(hi))]
                    add(0, int(bucket[at]), at, flat[part].tobytes(), _packed(part), None, None, None)
            ids, texts, counts, windows, held = [], [], [], [], 0
            whole = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _SENT], schema=_SENT)
            for at in range(0, whole.num_rows, 64):
                yield whole.slice(at, 64)

        for batch in batches:
            for doc_id, tie, text in rows(batch):
                found = rolled(word_hashes(raw_words(text)), width)
                if not len(found):
                    continue
                ids.append(doc_id), texts.append(tie), counts.append(len(found)), windows.append(found)
                held += len(found)
                if held >= CHUNK:
                    yield from flush()
        if held:
            yield from flush()
    return run


_ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("places", pa.binary()), ("ids", pa.list_(pa.int64())),
                     ("texts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_ANSWER_SQL = "chunk bigint, kind int, places binary, ids array<bigint>, texts array<bigint>, counts array<bigint>"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: one bucket is merged at a time."""
    current, held = None, []

    def settle():
        flat = np.concatenate([np.frombuffer(h, np.uint64) for _, h, _ in held])
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        twin = np.zeros(len(flat), bool)
        equal = ranked[1:] == ranked[:-1]
        twin[order[1:][equal]] = True
        twin[order[:-1][equal]] = True
        at, out = 0, []
        for chunk, h, places in held:
            mine = twin[at : at + len(h) // 8]
            at += len(h) // 8
            if mine.any():
                out.append((chunk, 2, _packed(_unpacked(places)[mine]), h, mine))
        return out

    def told(found):
        n = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([2] * n, pa.int32()), pa.array([f[2] for f in found], pa.binary())]
            + [pa.array([None] * n, pa.list_(pa.int64()))] * 3, schema=_ANSWER)

    for batch in batches:
        other = batch.filter(pc.not_equal(batch["kind"], 0))
        if other.num_rows:
            yield pa.RecordBatch.from_arrays([other[f.name] for f in _ANSWER], schema=_ANSWER)
        own = batch.filter(pc.equal(batch["kind"], 0))
        for bucket, chunk, hashes, places in zip(*[own[c].to_pylist() for c in ("bucket", "chunk", "hashes", "places")], strict=True):
            if bucket != current:
                if held:
                    yield told(settle())
                current, held = bucket, []
            held.append((chunk, hashes, places))
    if held:
        yield told(settle())


_SPANS = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("_from", pa.list_(pa.int32())), ("_to", pa.list_(pa.int32()))])


def _intervals(width: int):
    """The maximal intervals of words that a chunk's repeated windows cover, for each of its documents."""
    def run(rows_: pa.Table) -> pa.Table:
        kinds = rows_["kind"].to_pylist()
        places = [np.empty(0, np.int64)] + [_unpacked(p) for k, p in zip(kinds, rows_["places"].to_pylist(), strict=True) if k == 2]
        places = np.unique(np.concatenate(places))
        out = {f.name: [] for f in _SPANS}
        if len(places):
            head = kinds.index(1)
            ids, ties, counts = [rows_[c][head].as_py() for c in ("ids", "texts", "counts")]
            ends = np.cumsum(counts)
            owner = np.searchsorted(ends, places, side="right")
            spot = places - np.concatenate([[0], ends])[owner]
            new = np.ones(len(places), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (spot[1:] > spot[:-1] + width)
            start = np.nonzero(new)[0]
            last = np.append(start[1:], len(places)) - 1
            who = owner[start]
            for d in np.unique(who):
                lo, hi = np.searchsorted(who, (d, d + 1))
                out["_id"].append(ids[d]), out["_hash"].append(ties[d])
                out["_from"].append(spot[start[lo:hi]]), out["_to"].append(spot[last[lo:hi]] + width)
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in _SPANS}, schema=_SPANS)
    return run


def repeated_spans(docs: DataFrame, width: int = 35, bucket_mb: int = 16) -> DataFrame:
    """(_id, _hash, _from, _to): word intervals to remove, one row for each text that has any."""
    tie = F.coalesce(F.xxhash64("text"), F.lit(0))
    texts = docs.select(F.col("doc_id").alias("_id"), tie.alias("_tie"), F.col("text").alias("_text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(32, -(-size // (bucket_mb << 20)))
    sent = texts.mapInArrow(_send(width, buckets), _SENT_SQL)
    answers = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, _ANSWER_SQL)
    spans = answers.groupBy("chunk").applyInArrow(_intervals(width), "_id bigint, _hash bigint, _from array<int>, _to array<int>")
    return spans.groupBy("_id", "_hash").agg(F.min(F.struct("_from", "_to")).alias("_s")).select("_id", "_hash", "_s.*")


_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.string())])


def _cut_text(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = {f.name: [] for f in _CUT}
                for doc_id, text, starts, stops in rows(batch.slice(at, 512)):
                    words = raw_words(text)
                    kept, done = [], 0
                    for lo, hi in zip(starts or (), stops or (), strict=True):
                        kept += words[done:lo]
                        done = hi
                    kept += words[done:]
                    whole = b" ".join(kept)
                    out["doc_id"].append(doc_id), out["n_words"].append(len(words)), out["n_removed"].append(len(words) - len(kept))
                    out["spans"].append([list(s) for s in zip(starts or (), stops or (), strict=True)])
                    out["kept"].append(hashlib.sha256(whole).hexdigest() if digest else whole.decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _CUT], schema=_CUT)
    return run


def remove_repeats(docs: DataFrame, width: int = 35, digest: bool = False, bucket_mb: int = 16) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans ([from, to) word intervals), kept (the text, or its SHA-256)."""
    spans = repeated_spans(docs, width, bucket_mb).select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "_from", "_to")
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_tie"), "text")
    joined = texts.join(spans, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_h")), "left")
    return joined.select("_id", "text", "_from", "_to").mapInArrow(
        _cut_text(digest), "doc_id bigint, n_words bigint, n_removed bigint, spans array<array<int>>, kept string")
