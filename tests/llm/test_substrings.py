import hashlib
import random
from collections import Counter

import pytest

from skyledger.llm import substrings

from .common import HARD, WORD, clashing, documents


def brute(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                keep[k : k + width] = [False] * width
        out.append((len(w), len(w) - sum(keep), " ".join(x for x, y in zip(w, keep, strict=True) if y)))
    return out


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(60)]
    shared = [[draw.choice(vocabulary) for _ in range(n)] for n in (6, 9, 20)]
    texts = []
    for _ in range(60):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(0, 50))]
        if draw.random() < 0.5:
            at = draw.randint(0, len(w))
            w[at:at] = draw.choice(shared)
        texts.append(draw.choice([" ", "\n", "  "]).join(w))
    return texts + [texts[3], texts[3] + " tail", "p q " * 40, "solo " * 30] + HARD


@pytest.mark.parametrize(("width", "chunk"), [(6, 10**6), (6, 50), (9, 200), (35, 100)])
def test_equals_brute_force(spark, monkeypatch, width, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    texts = corpus(width)
    rows = substrings.remove_repeats(clashing(documents(spark, texts)), width).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows}
    assert len(rows) == len(texts) and got == dict(enumerate(brute(texts, width)))


def test_digest_and_spans(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"a b {passage} c", f"{passage} d", "clean text"]
    rows = {r["doc_id"]: r for r in substrings.remove_repeats(documents(spark, texts), 35, digest=True).collect()}
    assert rows[0]["spans"] == [[2, 42]] and rows[1]["spans"] == [[0, 40]] and rows[2]["spans"] == []
    assert rows[0]["kept"] == hashlib.sha256(b"a b c").hexdigest()


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"p{i}" for i in range(40))
    rows = substrings.remove_repeats(documents(spark, [text, text, None], ids=[1, 1, None])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (1, 40), (1, 40)]
    assert substrings.remove_repeats(documents(spark, ["a"]).where("false")).count() == 0


def test_places_round_trip():
    import numpy as np

    for places in ([], [0], [255], [254, 255, 511, 10**6], [0, 255, 510]):
        array = np.array(places, np.int64)
        assert substrings._unpacked(substrings._packed(array)).tolist() == places
