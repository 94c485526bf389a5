import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from skyledger.llm import minhash
from skyledger.llm.queries import QUERIES
from skyledger.llm.words import lowered_words, shingle_set

from .common import HARD, WORD, clashing, documents, lower
from .test_jaccard import corpus


def brute(rows, size=4, share=Fraction(4, 5)):
    """(n_shingles, component, kept) per doc_id, by all pairs."""
    sets = {}
    for i, text in rows:
        words = WORD.findall(lower(text))
        width = min(size, len(words))
        sets[i] = frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if words else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) * share.denominator >= len(x | y) * share.numerator:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    texts = corpus(seed, edits=0.2) + HARD
    assert got(minhash.near_duplicates(clashing(documents(spark, texts)))) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("leaf_rows", [5, 2048])
def test_cells_left_after_the_rounds(spark, monkeypatch, leaf_rows):
    """Without rounds, and with blocks of a few rows, the tasks find the same links."""
    from skyledger.llm import cells

    monkeypatch.setattr(cells, "ROUNDS", (0,))
    texts = corpus(5, groups=3, size=40, words=(60, 90), edits=0.35)
    assert got(minhash.near_duplicates(documents(spark, texts), leaf_rows=leaf_rows)) == brute(list(enumerate(texts)))


def test_posterior_bounds():
    """The least number of matches is where the Beta posterior's tail meets the miss probability."""
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, m in minhash.least_matches(Fraction(4, 5), 160, 1e-6):
        def tail(k, n=n):
            density = np.exp(k * np.log(grid) + (n - k) * np.log(1 - grid) - (math.lgamma(k + 1) + math.lgamma(n - k + 1) - math.lgamma(n + 2)))
            return density[grid >= 0.8].sum() / 200_000
        assert tail(m) >= 1e-6 > tail(m - 1)


def test_pruning_batches():
    draw = np.random.default_rng(2)
    one = draw.integers(0, 2**32, 160).astype(np.uint32)
    others = np.tile(one, (200, 1))
    rate = np.repeat([0.3, 0.6, 0.85, 1.0], 50)
    others[draw.random(others.shape) > rate[:, None]] ^= 1
    alive = minhash.plausible(one, others, minhash.least_matches(Fraction(4, 5), 160, 1e-9))
    assert set(range(100, 200)) <= set(alive.tolist()) and not set(range(50)) & set(alive.tolist())
    assert (minhash.plausible(np.tile(one, (200, 1)), others, minhash.least_matches(Fraction(4, 5), 160, 1e-9)) == alive).all()


def test_signatures_estimate_similarity():
    sets = [shingle_set(lowered_words(" ".join(f"w{i}" for i in range(a, a + 400))), 4) for a in (0, 40)]
    hashes = minhash.permutations(2000)
    a, b = (minhash.signature(s, hashes) for s in sets)
    assert abs((a == b).mean() - 357 / 437) < 0.04


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [text, text, "other words are here", text + " x", None], ids=[4, 4, 4, 9, None])
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert rows == [(-1, 0, None, True), (4, 1, 4, True), (4, 47, 4, True), (4, 47, 4, True), (9, 48, 4, False)]


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, ["a"]).where("false")).count() == 0


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op11_minhash_near_dedup"](spark, sf)) == brute(rows)
