"""Spelling variants: words one edit apart, by search schemes over a bidirectional FM-index.

A word is cut in two halves. A word one edit away has one of the halves unchanged, at its start or
its end; so either half is matched exactly, and the match is then extended across the other half up
to the word's delimiter, with one error allowed. The index is that of the circular text
``$word$word...`` and of its reverse, with rank tables of both; a search state is the pair of
suffix-rank intervals of the matched piece in both texts, kept in step, so that it can grow at
either end (Lam et al. 2009). All queries of a shard advance together in arrays.

*Shards.* The words that can match a half begin (or end) with it and differ in length by one at
most, so every word is indexed under the two possible first halves and the two last halves of such
queries, and a query goes to its own two halves. Shards are ranges of the hash of (side, half) with
some ``shard_words`` entries; a half of more words than that is salted, and its queries go to every
part. The index of a shard is therefore bounded, and no word meets the whole vocabulary.

*Counts.* Runs are counted in each batch before the shuffle. ``plant`` can delete one code point of
some occurrences, by a checksum of the document and the run.

Defined cases: a null text has no words, an empty table gives an empty result, a null doc_id counts
as an empty one in the checksum, repeated rows count as often as they occur, words may be of any
length, ties in the choice of a form go to the smallest word in code-point order; a form is at
least five times as frequent as its word, so chains of forms end. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import rows
from skyledger.session import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")


# ---- vocabulary


_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count(least_length: int, plant: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for doc_id, text in rows(batch):
                if not text:
                    continue
                runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if not plant:
                    total.update(runs)
                    continue
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    h = crc32(word.encode(), start)
                    if h % plant == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    total[word] += n
            kept = {w: n for w, n in total.items() if len(w) >= least_length}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], schema=_COUNTED)
    return run


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, plant: int | None = None) -> DataFrame:
    """(word, n): the words of ``docs`` that are long and frequent enough."""
    counted = docs.select("doc_id", "text").mapInArrow(_count(least_length, plant), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- the index of a shard


class Ranks:
    """Sorted rotations of a circular text of codes, with the number of each code before every rank."""

    def __init__(self, text: np.ndarray, codes: int):
        n = len(text)
        rank, step = text.astype(np.int64), 1
        while True:
            pair = rank * (max(n, codes) + 1) + np.roll(rank, -step)
            self.order = np.argsort(pair, kind="stable")
            held = pair[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.append(0, np.cumsum(held[1:] != held[:-1]))
            if step >= n or rank[self.order[-1]] == n - 1:
                break
            step *= 2
        before = text[self.order - 1]
        self.occurs = np.zeros((n + 1, codes), np.int32)
        self.occurs[np.arange(1, n + 1), before] = 1
        np.cumsum(self.occurs, axis=0, out=self.occurs)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=codes)))[:codes]


class BidirectionalIndex:
    """Distinct words behind a delimiter each (code 0), searchable to the left and to the right."""

    def __init__(self, words: list[str]):
        self.words = words
        letters = sorted(set("".join(words)))
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        self.codes = len(letters) + 1
        text = np.concatenate([[0, *map(self.code.__getitem__, w)] for w in words]).astype(np.int64)
        self.starts = np.nonzero(text == 0)[0]
        self.forward, self.backward = Ranks(text, self.codes), Ranks(text[::-1].copy(), self.codes)
        self.n = len(text)

    def encoded(self, word: str) -> list[int]:
        """Codes of a word; -1 for letters that no word here has."""
        return [self.code.get(c, -1) for c in word]

    def _pieces(self, state: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, Ranks]:
        """Of each state, the counts of all codes before its interval and inside it."""
        side = self.backward if right else self.forward
        at = state[:, 1 if right else 0]
        before = side.occurs[at]
        return before, side.occurs[at + state[:, 2]] - before, side

    def grow(self, state: np.ndarray, codes: np.ndarray, right: bool) -> np.ndarray:
        """States (rank in the text, rank in its reverse, size) grown by one code each; of size 0 if it does not follow."""
        before, inside, side = self._pieces(state, right)
        row, c = np.arange(len(state)), np.maximum(codes, 0)
        smaller = (np.cumsum(inside, 1) - inside)[row, c]
        out = np.empty_like(state)
        out[:, 1 if right else 0] = side.first[c] + before[row, c]
        out[:, 0 if right else 1] = state[:, 0 if right else 1] + smaller
        out[:, 2] = np.where(codes < 0, 0, inside[row, c])
        return out

    def branches(self, state: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Every (state, letter) that occurs."""
        _, inside, _ = self._pieces(state, right)
        row, c = np.nonzero(inside[:, 1:] > 0)
        return row, c + 1

    def near(self, queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs one edit apart in which the query's first half (``right``), or its last, is unchanged.

        That half is matched from the middle of the query outward to the delimiter, and then
        extended across the other half.
        """
        sizes = np.array([len(q) for q in queries], np.int64)
        flat = np.array([c for q in queries for c in self.encoded(q)], np.int64)
        offset = np.append(0, np.cumsum(sizes))[:-1]
        half = sizes // 2
        which = np.arange(len(queries))
        state = np.tile(np.array([0, 0, self.n], np.int64), (len(queries), 1))
        steps = half if right else sizes - half
        for k in range(int(steps.max(initial=0)) + 1):  # the exact half, and its delimiter
            if not len(which):
                break
            inside, last = steps[which] > k, steps[which] == k
            at = half[which] - 1 - k if right else half[which] + k
            codes = np.where(inside, flat[np.minimum(offset[which] + np.where(inside, at, 0), len(flat) - 1)], 0)
            state = np.where((inside | last)[:, None], self.grow(state, codes, not right), state)
            alive = state[:, 2] > 0
            which, state = which[alive], state[alive]
        done = np.zeros(len(which), np.int64)  # letters of the other half that are passed
        wrong = np.zeros(len(which), bool)
        rest = sizes - steps
        found: list[np.ndarray] = []
        while len(which):
            end = done == rest[which]
            at = steps[which] + done if right else half[which] - 1 - done
            code = np.where(end, 0, flat[np.minimum(offset[which] + np.where(end, 0, at), len(flat) - 1)])
            same = self.grow(state, code, right)
            fits = same[:, 2] > 0
            if (hit := fits & wrong & end).any():
                place = self.forward.order[same[hit, 0]]  # of the delimiter before the word
                found.append(np.stack([which[hit], np.searchsorted(self.starts, place, side="right") - 1], 1))
            go = fits & ~end
            parts = [(which[go], done[go] + 1, wrong[go], same[go])]
            free = np.nonzero(~wrong)[0]
            if len(free):
                row, letter = self.branches(state[free], right)
                row = free[row]
                grown = self.grow(state[row], letter, right)
                other = ~end[row] & (letter != code[row])
                yes = np.ones(len(row), bool)
                parts.append((which[row][other], done[row][other] + 1, yes[other], grown[other]))  # replaced
                parts.append((which[row], done[row], yes, grown))  # inserted
                short = free[~end[free]]
                parts.append((which[short], done[short] + 1, np.ones(len(short), bool), state[short]))  # deleted
            which, done, wrong, state = (np.concatenate([p[k] for p in parts]) for k in range(4))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


_PAIR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _search(step: int = 2048):
    """Pairs of each shard: its index rows come first, then its queries; one shard is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, counts, index, asked = None, {}, None, {True: [], False: []}

        def answer(side):
            nonlocal index
            queries, asked[side] = asked[side], []
            if not counts or not queries:
                return
            if index is None:
                index = BidirectionalIndex(sorted(counts))
            q, w = index.near(queries, side)
            found = [index.words[k] for k in w]
            yield pa.RecordBatch.from_arrays([pa.array([queries[k] for k in q], pa.string()), pa.array(found, pa.string()),
                                              pa.array([counts[f] for f in found], pa.int64())], schema=_PAIR)

        for batch in batches:
            for at, query, right, word, n in rows(batch):
                if at != shard:
                    for side in (True, False):
                        yield from answer(side)
                    shard, counts, index = at, {}, None
                if query:
                    asked[right].append(word)
                    if len(asked[right]) >= step:
                        yield from answer(right)
                else:
                    counts[word] = n
        for side in (True, False):
            yield from answer(side)
    return run


def near_pairs(words: DataFrame, shard_words: int = 4096) -> DataFrame:
    """(word, near, near_n): each two distinct ``words(word, n)`` that differ by one inserted, deleted or replaced code point."""
    size = F.char_length("word")
    half = F.floor(size / 2).cast("int")

    def halves(length) -> list:
        """Of each word: its key as the first half (right) and the last half of a query of ``length``."""
        first = F.floor(length / 2).cast("int")
        return [F.struct(F.lit(True).alias("right"), F.substring(F.col("word"), F.lit(1), first).alias("key")),
                F.struct(F.lit(False).alias("right"), F.substring(F.col("word"), size - (length - first) + 1, length - first).alias("key"))]

    of = F.array_distinct(F.array(*[k for d in (-1, 0, 1) for k in halves(F.greatest(size + d, F.lit(2)))]))
    entries = cut(words.select("word", "n", F.explode(of).alias("_k")).select("word", "n", "_k.*"))
    sizes = entries.groupBy("right", "key").agg(F.count(F.lit(1)).alias("_m"))
    shards = max(1, -(-entries.count() // shard_words))
    sizes = sizes.select("right", "key", F.ceil(F.col("_m") / shard_words).cast("int").alias("_salts"))

    def placed(salt):
        return F.pmod(F.xxhash64("right", "key", salt), F.lit(shards)).cast("int").alias("shard")

    salted = entries.join(sizes.where("_salts > 1"), ["right", "key"], "left")
    index = salted.select(placed(F.pmod(F.xxhash64("word"), F.coalesce("_salts", F.lit(1))).cast("int")), F.lit(False).alias("query"),
                          F.lit(True).alias("right"), "word", "n").distinct()
    asking = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(True).alias("right"), F.substring(F.col("word"), F.lit(1), half).alias("key")),
        F.struct(F.lit(False).alias("right"), F.substring(F.col("word"), half + 1, size - half).alias("key")))).alias("_k")).select("word", "n", "_k.*")
    asking = asking.join(sizes.where("_salts > 1"), ["right", "key"], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    queries = asking.select(placed(F.col("_salt")), F.lit(True).alias("query"), "right", "word", "n").distinct()
    dealt = index.unionAll(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "query")
    return dealt.mapInArrow(_search(), "word string, near string, near_n bigint").distinct()


def spelling_groups(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, plant: int | None = None,
                    shard_words: int = 4096) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    The form is the near word of the largest n, if that is ``ratio`` times the word's n or more;
    the root is where the chain of forms ends.
    """
    words = cut(vocabulary(docs, least_length, least_count, plant))
    best = near_pairs(words, shard_words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_o"), F.col("near").alias("form"))).alias("_b"))
    fits = -F.col("_b._o") >= ratio * F.col("n")
    table = cut(words.join(best, "word", "left").select(
        "word", F.when(fits, F.col("_b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, -F.col("_b._o")).alias("form_n")))
    # every step doubles the part of the chain that is followed, and n grows by the ratio along it
    roots = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
