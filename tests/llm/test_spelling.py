import random
import re
from collections import Counter
from zlib import crc32

import pytest

from skyledger.llm import spelling
from skyledger.llm.queries import QUERIES

from .common import HARD, clashing, documents, lower


def words_of(rows, plant=None, least=6, often=5):
    total = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(word)
            h = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if plant and h % plant == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def got(frame):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect())


def texts_of(seed, letters="abé", count=60, length=(4, 9)):
    """Words over few letters, so that many are one apart, with steep frequencies."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice(letters) for _ in range(draw.randint(*length))) for _ in range(count)]
    weights = [4.0 ** -(k % 6) for k in range(count)]
    return [" ".join(draw.choices(vocabulary, weights, k=150)) for _ in range(20)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("shard_words", [7, 4096])
def test_equals_all_pairs(spark, seed, shard_words):
    texts = texts_of(seed) + HARD
    docs = clashing(documents(spark, texts, ids=[None if k == 3 else k for k in range(len(texts))]))
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)]
    assert got(spelling.spelling_groups(docs, plant=19, shard_words=shard_words)) == brute(words_of(rows, plant=19))


def test_index_finds_what_is_one_apart():
    draw = random.Random(4)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(3, 8))) for _ in range(150)})
    index = spelling.BidirectionalIndex(words)
    queries = [*words, "zzzz", "abzab", "abab" * 10]
    first, last = (set(zip(*map(list, index.near(queries, right)), strict=True)) for right in (True, False))
    want = {(q, w) for q, a in enumerate(queries) for w, b in enumerate(words) if one_apart(a, b)}
    assert first | last == want
    assert first == {(q, w) for q, w in want if words[w].startswith(queries[q][: len(queries[q]) // 2]) and
                     one_apart(queries[q][len(queries[q]) // 2 :], words[w][len(queries[q]) // 2 :])}


def test_long_words_chains_and_repeats(spark):
    long = "x" * 3000 + "y" * 3000
    texts = [f"{long} {long}z {long}", f"{long} {long}", "abcdef " * 500, "abcdefg " * 90, "abcdefgh " * 15, "abcdefgh abcdefg abcdef", None, "", "abcdefgz " * 7]
    texts += [f"{long}z"] * 4
    docs = documents(spark, texts)
    want = brute(words_of(list(enumerate(texts))))
    assert got(spelling.spelling_groups(docs)) == want
    assert ("abcdefgh", "abcdefg", "abcdef", 16, 2, 91) in want


def test_empty_table(spark):
    assert spelling.spelling_groups(documents(spark, ["a"]).where("false")).count() == 0
    assert spelling.spelling_groups(documents(spark, [None, "", "few words"])).count() == 0


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op12_spelling_variants"](spark, sf)) == brute(words_of(rows, plant=199))
