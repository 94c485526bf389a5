import random
import zlib

import numpy as np

from skyledger.llm import language

from .common import HARD, clashing, documents

SYLLABLES = {"xa": "the ing tion wh er es", "xb": "der ung sch eit ich aus", "xc": "él que ción los ría", "xd": "日本 語の です ます 中文"}


def corpus(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        lang = draw.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        rows.append((" ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(5, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(400)
    docs = clashing(documents(spark, [t for t, _ in rows], langs=[x for _, x in rows]))
    got = {r["doc_id"]: r for r in language.predict_languages(docs).collect()}
    assert len(got) == 400
    held = [i for i in got if got[i]["held_out"]]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2] and len(held) > 50
    assert np.mean([got[i]["lang_pred"] == rows[i][1] for i in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    rows = corpus(200)
    texts, langs = [t for t, _ in rows], [x for _, x in rows]
    spoilt = ["zz" if zlib.crc32(str(i).encode()) % 4 == 2 else x for i, x in enumerate(langs)]
    one = language.predict_languages(documents(spark, texts, langs=langs)).orderBy("doc_id").collect()
    two = language.predict_languages(documents(spark, texts, langs=spoilt, sources=["other"] * 200)).orderBy("doc_id").collect()
    assert one == two


def test_hard_rows(spark):
    rows = corpus(60)
    docs = documents(spark, HARD + [t for t, _ in rows], langs=[None] * len(HARD) + [x for _, x in rows])
    got = {r["doc_id"]: r for r in language.predict_languages(docs).collect()}
    for i, text in enumerate(HARD):
        letterless = not any(c.isalpha() for c in text or "")
        assert (got[i]["lang_pred"] == "und") == letterless and (got[i]["score"] == 0 or not letterless)
    kept = language.keep_identified(clashing(docs))
    assert kept.columns == clashing(docs).columns


def test_no_training_rows_and_empty_table(spark):
    docs = documents(spark, ["some words"], langs=[None])
    assert [(r["lang_pred"], r["score"]) for r in language.predict_languages(docs).collect()] == [("und", 0.0)]
    assert language.predict_languages(docs.where("false")).count() == 0


def test_vectors_equal_the_definition():
    texts = ["Abc de", "", "x\x00y".replace("\x00", " "), "éa  !! b", "日本語 a"]
    vectors, letters = language.text_vectors(texts)
    for text, vector, n in zip(texts, vectors, letters, strict=True):
        runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        spaced = " " + " ".join(runs) + " " if runs else ""
        want = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(spaced, spaced[1:], spaced[2:], strict=False):
            if b != " ":
                x, y, z = (language.letter_vector(ord(k)).astype(int) for k in (a, b, c))
                want += np.roll(x, 2) * np.roll(y, 1) * z
        assert n == sum(map(len, runs)) and np.array_equal(vector, want)
