import hashlib
import random

import numpy as np
import pytest

from skyledger.llm import fingerprints as fp

from .common import HARD, clashing, documents


def corpus(seed, n=150):
    draw = random.Random(seed)
    lines = [" ".join(draw.choice(["alpha", "beta", "é", "gamma."]) for _ in range(draw.randint(1, 8))) for _ in range(80)]
    return ["\n".join(draw.choice(lines) for _ in range(draw.randint(0, 40))) for _ in range(n)] + HARD


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, parts):
    texts = corpus(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = {r["doc_id"]: r for r in fp.compare_versions(clashing(documents(spark, texts)).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plain = [t or "" for t in texts]
    assert len(rows) == len(texts)
    for i, text in enumerate(plain):
        following = plain[i - 1]  # the smallest id is followed by the largest
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        a, b, c = (set(fp.paragraph_digests(t).tolist()) for t in (text, edited, following))
        near = lambda x, y: round(len(x & y) / len(x | y), 6) if x | y else 1.0
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(near(a, b), abs=1e-6) and r["near_next"] == pytest.approx(near(a, c), abs=1e-6)
        assert (r["n_removed"], r["n_added"]) == (len(a - b), len(b - a))
        for j in range(i):
            if plain[j] == text:
                assert rows[j]["fingerprint"] == r["fingerprint"]


def test_peeling_recovers_digests_and_doubles_on_failure():
    draw = np.random.default_rng(1)
    lefts, rights = [], []
    for n in (0, 1, 5, 40, 400, 3000):
        shared, a, b = (draw.integers(0, 2**63, k).astype(np.uint64) for k in (500, n, n // 2))
        lefts.append(np.concatenate([shared, a])), rights.append(np.concatenate([b, shared]))
    found, cells = fp.differences(lefts, rights)
    for (only_left, only_right), left, right in zip(found, lefts, rights, strict=True):
        assert set(only_left.tolist()) == set(left.tolist()) - set(right.tolist())
        assert set(only_right.tolist()) == set(right.tolist()) - set(left.tolist())
    assert cells[0] == fp.CELLS and cells[-1] > 3000


def test_repeated_ids_single_row_and_empty_table(spark):
    one = documents(spark, ["Abc def. Ghi."], ids=[5])
    r = fp.compare_versions(one).collect()
    assert [(x["doc_id"], x["near_next"]) for x in r] == [(5, 1.0)]
    many = documents(spark, ["a. b. c."] * 40 + ["d. e."] * 3 + [None], ids=[1] * 40 + [2, 2, 2] + [None])
    rows = fp.compare_versions(many).collect()
    assert len(rows) == 44 and len({x["fingerprint"] for x in rows if x["doc_id"] == 1}) == 1
    assert fp.compare_versions(one.where("false")).count() == 0
