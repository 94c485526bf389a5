import random

import pytest

from skyledger.llm import decontaminate

from .common import HARD, ITEM_WORD, clashing, documents, lower


def cut_up(text):
    return ITEM_WORD.findall(lower(text))


def brute(texts, items, size=13):
    grams = {}
    for item, text in items:
        w = cut_up(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(item)
    lengths, out = {len(g) for g in grams}, []
    for text in texts:
        w, hit, found = cut_up(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(12)] + ["É", "中", "7"]
    item = lambda n: draw.choice([" ", ", ", "-"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 8, 9, 12, 13, 14, 20, 30])] + [(2, "second text of two"), (3, None), (50, " ,.")]
    texts = []
    for _ in range(80):
        parts = [item(draw.randint(0, 40))]
        if draw.random() < 0.6:
            parts.insert(draw.randint(0, 1), draw.choice(items)[1] or "")
        texts.append(" ".join(parts).title() if draw.random() < 0.5 else " ".join(parts))
    return texts + HARD, items


@pytest.mark.parametrize(("seed", "least"), [(1, 0), (2, 5), (3, 9), (4, 13)])
def test_equals_brute_force(spark, seed, least):
    texts, items = corpus(seed)
    items = [x for x in items if len(cut_up(x[1])) >= least]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.judge(clashing(documents(spark, texts)), clashing_items(table)).collect()}
    assert got == dict(enumerate(brute(texts, items)))


def clashing_items(table):
    from pyspark.sql import functions as F

    return table.select("*", F.lit(1).alias("length"), F.lit("x").alias("gram"), F.lit(2).alias("doc_id"))


def test_join_without_broadcast_is_the_same(spark, monkeypatch):
    texts, items = corpus(5)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 0)
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.judge(documents(spark, texts), table).collect()}
    assert got == {i: x[1] for i, x in enumerate(brute(texts, items))}


def test_drop_and_cut(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    items = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    texts = [f"Intro {passage} outro", "x " * 400 + passage, None, "clean", f"Intro {passage} outro"]
    docs = clashing(documents(spark, texts, ids=[1, 2, 3, 4, 1]))
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    spans = decontaminate.cut_spans(docs, items)
    assert spans.columns == docs.columns
    assert sorted((r["doc_id"], r["text"][:12] if r["text"] else r["text"]) for r in spans.collect() if r["doc_id"] != 3) == [
        (1, "intro outro"), (1, "intro outro"), (2, "x x x x x x "), (4, "clean")]


def test_empty_tables_and_repeated_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta")], "item_id bigint, text string")
    docs = documents(spark, ["alpha beta", "alpha beta", "alpha gamma"], ids=[1, 1, 1])
    assert sorted(r["n_hit"] for r in decontaminate.judge(docs, items).collect()) == [0, 2, 2]
    assert decontaminate.judge(docs.where("false"), items).count() == 0
    assert sorted(r["n_hit"] for r in decontaminate.judge(docs, items.where("false")).collect()) == [0, 0, 0]
    assert decontaminate.drop_contaminated(docs, items.where("false")).count() == 3


def test_main_path_has_no_python(spark):
    docs, items = documents(spark, ["a b c"]), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    plan = decontaminate.judge(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
