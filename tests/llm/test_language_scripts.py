"""Texts in letters that the training rows do not hold."""

import random

from skyledger.llm import language

from .common import documents
from .test_language import corpus


def test_scripts_that_were_not_learned_stay(spark):
    rows, draw = corpus(80), random.Random(3)
    letters = [chr(c) for c in range(0x10D0, 0x10F0)]
    rare = [" ".join("".join(draw.choice(letters) for _ in range(draw.randint(3, 8))) for _ in range(20)) for _ in range(40)]
    docs = documents(spark, [t for t, _ in rows] + rare + ["12 !", None], langs=[x for _, x in rows] + [None] * 42)
    scores = {r["doc_id"]: r["score"] for r in language.predict_languages(docs).collect()}
    assert any(scores[i] == 0 for i in range(80, 120))  # cosines below 0, told as 0
    assert sorted(r["doc_id"] for r in language.keep_identified(docs).collect()) == list(range(120))
    assert sorted(r["doc_id"] for r in language.keep_identified(docs, least=0.0).collect()) == [i for i in range(120) if scores[i] > 0]
