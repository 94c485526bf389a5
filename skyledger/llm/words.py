"""Word and shingle hashes of texts inside tasks, and helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd 64-bit multipliers of the word-sequence hashes.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def rows(batch: pa.RecordBatch, step: int = 512) -> Iterator[tuple]:
    """The rows of a batch as tuples; only ``step`` rows are Python objects at a time."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*[column.to_pylist() for column in part.columns], strict=True)


def lowered_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of the whole run if there are fewer."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes, width = word_hashes(words), min(size, n)
    total = np.full(n - width + 1, width, np.uint64)  # shorter runs differ from longer ones
    with np.errstate(over="ignore"):
        for k in range(width):
            total = (total + hashes[k : n - width + 1 + k]) * np.uint64(MIX[k % 3])
            total ^= total >> np.uint64(32)
    return np.unique(total)


def table(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
