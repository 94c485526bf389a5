import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from skyledger.llm import jaccard, rare_keys
from skyledger.llm.words import lowered_words, shingle_set

from .common import HARD, WORD, clashing, documents, lower


def shingles(text):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[k : k + 3]) for k in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def brute(rows, share=Fraction(9, 10)):
    """(n_shingles, component) per doc_id, by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
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
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed, groups=12, size=8, words=(3, 160), edits=0.12):
    """Chains of edited copies around the threshold."""
    draw, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(*words))]
        for _ in range(size):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(draw.randint(0, max(1, int(len(text) * edits / 4)))):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                text += [draw.choice(vocabulary) for _ in range(draw.randint(0, max(1, len(text) // 20)))]
    draw.shuffle(out)
    return out


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    texts = corpus(seed)
    assert got(jaccard.link_documents(documents(spark, texts))) == brute(list(enumerate(texts)))


def test_regions_split_on_spark_equal_all_pairs(spark):
    """Tiny limits force Voronoi rounds, and blocks where pivots tell nothing apart."""
    texts = corpus(7, groups=2, size=60, words=(80, 120), edits=0.25) + corpus(8, groups=4)
    frame = jaccard.link_documents(documents(spark, texts), leaf_rows=12, slab=8, pivots=4)
    assert got(frame) == brute(list(enumerate(texts)))


def test_lower_share_and_hard_rows(spark):
    texts = HARD + corpus(4, groups=4, edits=0.3)
    docs = clashing(documents(spark, texts))
    assert got(jaccard.link_documents(docs)) == brute(list(enumerate(texts)))
    assert got(jaccard.link_documents(docs, share=Fraction(8, 10))) == brute(list(enumerate(texts)), Fraction(8, 10))


def linked_pairs(texts, share):
    """(links of each, root of each) by all pairs."""
    sets = [shingles(t) for t in texts]
    links = [0] * len(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) * share.denominator >= len(sets[a] | sets[b]) * share.numerator:
            links[a] += 1
            links[b] += 1
    return links


@pytest.mark.parametrize("edits", [0.05, 0.2])
def test_region_recursion_equals_all_pairs(edits):
    texts = list(dict.fromkeys(corpus(11, groups=3, size=120, words=(60, 90), edits=edits)))
    region = jaccard.Region(list(range(len(texts))), [shingle_set(lowered_words(t), 3) for t in texts], [1] * len(texts))
    region.find(np.arange(len(texts)), np.ones(len(texts), bool), Fraction(9, 10), small=8)
    assert [region.root(i) for i in range(len(texts))] == [c for _, c in brute(list(enumerate(texts))).values()]
    assert region.links.tolist() == linked_pairs(texts, Fraction(9, 10))


@pytest.mark.parametrize("leaf_rows", [12, 2048])
def test_links_are_counted(spark, leaf_rows):
    """Copies count as links; tiny regions are split by pivots and cut into blocks."""
    texts = HARD + corpus(9, groups=3, size=40, words=(60, 90), edits=0.1)
    texts += texts[-5:]
    frame = jaccard.link_documents(documents(spark, texts), leaf_rows=leaf_rows, slab=8, pivots=4)
    assert [r["n_links"] for r in frame.orderBy("doc_id").collect()] == linked_pairs(texts, Fraction(9, 10))


@pytest.mark.parametrize("share", [Fraction(9, 10), Fraction(4, 5)])
def test_linked_sets_share_a_key(spark, share):
    texts = corpus(13, groups=10, size=6, words=(3, 120), edits=0.3) + ["a b", "a", "a b c d"]
    frame = documents(spark, texts).selectExpr("doc_id as _id", "text as _text")
    described, keys = rare_keys.describe_sets(frame, share, 3)
    held = {}
    for r in keys.collect():
        held.setdefault(r["_id"], set()).add(r["key"])
    sets = [shingles(t) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] != sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
            assert held.get(a, set()) & held.get(b, set()), (texts[a], texts[b])
    assert described.count() == len(texts)


def test_cells_do_not_run_together(spark):
    """Texts that share passages but are no near copies: the largest cell stays small as the table grows."""
    largest = []
    for times in (1, 2, 4):
        draw = random.Random(5)
        passages = [" ".join(f"p{draw.randint(0, 10**6)}" for _ in range(25)) for _ in range(5)]
        texts = []
        for _ in range(200 * times):
            own = [f"v{draw.randint(0, 10**6)}" for _ in range(draw.randint(80, 110))]
            texts.append(" ".join(own) + " " + draw.choice(passages))
            if draw.random() < 0.2:
                own[draw.randrange(len(own))] = "x"
                texts.append(" ".join(own) + " " + draw.choice(passages))
        frame = documents(spark, texts).selectExpr("doc_id as _id", "text as _text")
        _, keys = rare_keys.describe_sets(frame, Fraction(4, 5), 5)
        largest.append(keys.distinct().groupBy("key").count().agg({"count": "max"}).first()[0] or 1)
    assert max(largest) <= 8, largest


def test_one_of_each_group_stays(spark):
    texts = corpus(5, groups=5) + ["", None, None]
    docs = clashing(documents(spark, texts))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted({c for _, c in brute(list(enumerate(texts))).values()})
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [text, text, "other words are here", text + " x", None], ids=[4, 4, 4, 9, None])
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs).collect())
    assert rows == [(-1, 0, None), (4, 2, 4), (4, 48, 4), (4, 48, 4), (9, 49, 4)]
    assert sorted((r["doc_id"] or -1) for r in jaccard.keep_one(docs).collect()) == [-1, 4]


def test_empty_table(spark):
    empty = documents(spark, ["a"]).where("false")
    assert jaccard.link_documents(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0
