"""License scans: winnowed fingerprints pick candidate templates, alignment around the hits measures them.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. All k-word runs of a
template are hashed, and of each ``window`` neighbouring hashes the smallest (the rightmost of
equal ones) is kept in an inverted index; texts are winnowed alike, so a text that repeats
``window + k - 1`` words of a template shares a kept hash with it. Hashes of a text with words
that no template has cannot match and count as infinite, which changes no window that lies in a
repeated passage. The words that a copy around one of a template's hits may take, and as many
more on both sides as the least coverage lets be missing (8 at least), are put in a row and
aligned with the template; the share of the template's words that align is the coverage. What
stands between two pieces of a copy does not count, however long, so pieces that follow each
other in template order are one copy. Each disjoint copy is reported.

The templates are a written list, so the index's size is fixed; it goes with the task.

Defined cases: null and wordless texts match nothing; texts of any length are read whole; a
template may match several times; overlapping matches of several templates are all reported;
repeated rows are scanned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import rows, scramble

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
NEVER = np.uint64(2**64 - 1)


def tokens(text: str | None) -> list[bytes]:
    return TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the rightmost of equal ones."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    width = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], width)
    at = n - 1 - (views.argmin(1) + np.arange(n - width + 1))
    return np.unique(at)


class Index:
    def __init__(self, templates: dict[str, str], k: int = 3, window: int = 3):
        self.k, self.window = k, window
        self.names = sorted(templates)
        self.words = [tokens(templates[n]) for n in self.names]
        self.code: dict[bytes, int] = {}
        for words in self.words:
            for w in words:
                self.code.setdefault(w, len(self.code) + 1)
        self.ids = [np.array([self.code[w] for w in words], np.int64) for words in self.words]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.ids):
            hashes = self.hashes(ids)
            for at in winnow(hashes, window).tolist():
                self.places[int(hashes[at])].append((t, at))
        self.keys = np.array(sorted(self.places), np.uint64)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total, whole = np.zeros(n, np.uint64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for j in range(self.k):
                part = ids[j : j + n]
                total = scramble(total + part.astype(np.uint64) + np.uint64(j + 1))
                whole &= part > 0
        return np.where(whole, total, NEVER)

    def scan(self, text: str | None, least: float, slack: int = 8) -> tuple[int, list[tuple[str, float, int, int]]]:
        """(words, [(template, coverage, first word, end word)]) of a text."""
        words = tokens(text)
        code = self.code.get
        ids = np.fromiter((code(w, 0) for w in words), np.int64, len(words))
        hashes = self.hashes(ids)
        if not len(hashes) or not (hashes != NEVER).any():
            return len(words), []
        kept = winnow(hashes, self.window)
        kept = kept[np.isin(hashes[kept], self.keys)]
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in kept.tolist():
            for t, place in self.places[int(hashes[at])]:
                found[t].append((at - place, at))
        out: list[tuple[str, float, int, int]] = []
        for t, hits in found.items():
            size = len(self.ids[t])
            need = next((n for n in range(1, size + 1) if round(n / size, 6) >= least), size + 1)
            reach = max(slack, size - need)
            whole = self.align(t, ids, hits, reach)
            if whole and whole[0] >= least:
                out += [(self.names[t], *match) for match in self.copies(t, ids, hits, need, reach)]
        return len(words), sorted(out, key=lambda m: (m[2], m[0]))

    def near(self, t: int, n: int, hits: list[tuple[int, int]], reach: int) -> np.ndarray:
        """Places of the words that a copy around one of the hits may take, with ``reach`` more on both sides."""
        low = np.array([h[0] for h in hits], np.int64) - reach
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, np.clip(low, 0, n), 1)
        np.add.at(steps, np.clip(low + len(self.ids[t]) + 2 * reach, 0, n), -1)
        return np.nonzero(np.cumsum(steps[:-1]) > 0)[0]

    def ends(self, t: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, begin) of the longest common subsequence with the template in each prefix of ``words``; the latest begin of equal ones."""
        n = len(words)
        one = n + 1  # a value is length * one + begin + 1
        value, fresh = np.zeros(n + 1, np.int64), one + np.arange(1, n + 1)
        for word in self.ids[t]:
            at = np.nonzero(words == word)[0]
            if len(at):
                now = value.copy()
                now[at + 1] = np.maximum(value[at + 1], np.where(value[at] > 0, value[at] + one, fresh[at]))
                value = np.maximum.accumulate(now)
        return value // one, value % one - 1

    def align(self, t: int, ids: np.ndarray, group: list[tuple[int, int]], slack: int) -> tuple[float, int, int] | None:
        """Longest common subsequence of the template and the words around the hits: (coverage, first word, end word)."""
        places = self.near(t, len(ids), group, slack)
        length, begin = self.ends(t, ids[places])
        if not length[-1]:
            return None
        stop = int(np.searchsorted(length, length[-1]))
        return round(float(length[-1]) / len(self.ids[t]), 6), int(places[begin[stop]]), int(places[stop - 1]) + 1

    def copies(self, t: int, ids: np.ndarray, hits: list[tuple[int, int]], need: int, reach: int) -> list[tuple[float, int, int]]:
        """Disjoint alignments of ``need`` words or more, from left to right.

        The first place where so many words align ends a copy, and its latest begin starts it; the
        search goes on behind it. A copy then grows into the words between its neighbours.
        """
        size = len(self.ids[t])
        places = self.near(t, len(ids), hits, reach)
        words, cores, low, width = ids[places], [], 0, 4 * size + 64
        while low < len(words):
            length, begin = self.ends(t, words[low : low + width])
            stop = int(np.searchsorted(length, need))
            if stop < len(length):
                cores.append((low + int(begin[stop]), low + stop))
                low, width = low + stop, 4 * size + 64
            elif low + width >= len(words):
                break
            else:
                width *= 2
        out, left = [], 0
        for (start, stop), (right, _) in zip(cores, cores[1:] + [(len(words), 0)], strict=True):
            low, more = max(left, start - (size - need) - reach), size - need + reach
            length, begin = self.ends(t, words[low : min(right, stop + more)])
            stop = int(np.searchsorted(length, length[-1]))
            left = low + stop
            out.append((round(float(length[-1]) / size, 6), int(places[low + begin[stop]]), int(places[left - 1]) + 1))
        return out


_OUT_SQL = "doc_id bigint, n_words bigint, license string, coverage double, matches array<struct<license:string,coverage:double,start:int,stop:int>>"


def _scan(templates: dict[str, str], least: float, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, k, window)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in rows(batch):
                n, matches = index.scan(text, least)
                best = max(matches, key=lambda m: (m[1], m[3] - m[2], m[0]), default=None)
                for column, value in zip(out, (doc_id, n, best and best[0], best[1] if best else 0.0,
                                               [dict(zip(("license", "coverage", "start", "stop"), m, strict=True)) for m in matches]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.float64(), kind), strict=True)],
                names=["doc_id", "n_words", "license", "coverage", "matches"])
    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str], least: float = 0.8, k: int = 3, window: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, its best license and coverage (null and 0), and all matches with their word spans."""
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(_scan(templates, least, k, window), _OUT_SQL)
