"""Rules of the pipeline's stages that differ from the operators' own queries."""

import itertools
from fractions import Fraction

import corpus_pipeline

from .common import WORD, documents, lower
from .test_jaccard import corpus

SF = "/root/testdata/sf0.001"


def kept_by_hand(texts, size=5, share=Fraction(4, 5)):
    """Smallest id of each group of texts linked on five words at 0.8, by all pairs."""
    sets = []
    for text in texts:
        words = WORD.findall(lower(text))
        width = min(size, len(words))
        sets.append({tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return [i for i in range(len(sets)) if root(i) == i]


def test_near_duplicates_are_judged_on_five_words(spark):
    words = [f"v{i}" for i in range(94)]
    edited = list(words)
    edited[20], edited[60] = "x", "y"  # 90 shingles, 80 shared: exactly 0.8; three words: 86 of 98, 0.878
    texts = [" ".join(words), " ".join(edited), "few words"] + corpus(21, groups=6, edits=0.3)
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, texts), SF)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert 1 not in ids and ids == kept_by_hand(texts)


def test_near_duplicates_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [texts[i][0] for i in kept_by_hand([t for _, t in texts])]
