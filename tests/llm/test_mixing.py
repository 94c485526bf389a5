import hashlib
import math
import random

import pytest

from skyledger.llm import mixing

from .common import HARD, WORD, clashing, documents


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Clamp and share again until nothing is above its cap; ``sizes`` in order."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in clamped]
        rest = total - sum(clamped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return clamped | share
        clamped |= {s: cap * sizes[s] for s in over}


def brute(rows):
    """doc -> (size, source size, target, taken) for distinct ids."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    sizes = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    target, out = targets(sizes), {}
    for s in names:
        run, whole = 0, math.floor(target[s] / sizes[s] + 1e-12) if sizes[s] else 0
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: (hashlib.md5(f"mix|{i}".encode()).hexdigest(), i)):
            run += size[i]
            more = size[i] > 0 and run - size[i] / 2 <= target[s] - whole * sizes[s]
            out[i] = (size[i], sizes[s], target[s], size[i] * min(3, whole + more) if size[i] else 0)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_equals_brute_force(spark, seed):
    draw = random.Random(seed)
    sources = [draw.choice(["a", "B", "é", "", None, "zz", "hot", "hot", "hot", "hot"]) for _ in range(120)]
    texts = [" ".join(["w"] * draw.choice([0, 1, 3, 10, 200 if seed % 2 else 5])) for _ in sources[: -len(HARD)]] + HARD
    docs = documents(spark, texts, sources=sources)
    want = brute(list(zip(range(len(texts)), texts, sources, strict=True)))
    got = {r["doc_id"]: r for r in mixing.mix_plan(clashing(docs)).collect()}
    assert len(got) == len(want)
    for i, (size, whole, target, taken) in want.items():
        r = got[i]
        assert (r["size"], r["source_size"]) == (size, whole) and r["target"] == pytest.approx(target) and r["taken"] == taken
        assert r["taken"] <= 3 * size
    assert sum({r["source"]: r["target"] for r in got.values()}.values()) == pytest.approx(sum(x[0] for x in want.values()))


def test_rows_repeat_as_planned(spark):
    draw = random.Random(9)
    texts = [" ".join(["w"] * draw.randint(0, 9)) for _ in range(60)]
    docs = clashing(documents(spark, texts, sources=[draw.choice("abc") for _ in texts]))
    plan = {r["doc_id"]: r["times"] for r in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in plan.items() if n}


def test_many_sources_and_extremes(spark):
    docs = documents(spark, ["w " * 1000] + ["w"] * 300, sources=["big"] + [f"s{i}" for i in range(300)])
    rows = mixing.mix_plan(docs).collect()
    assert max(r["target"] for r in rows if r["source"] != "big") <= 3.0
    assert sum(r["taken"] for r in rows) <= 3 * 1300
    wordless = mixing.mix_plan(documents(spark, [None, "", " "], sources=["a", "b", None])).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in wordless)


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, ["a b", "a b", "c"], ids=[1, 1, 2], sources=["x", "x", "x"])
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix_plan(docs).collect()) == [(1, 2), (1, 2), (2, 1)]
    assert mixing.mix_plan(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("false")).count() == 0


def test_main_path_has_no_python(spark):
    plan = mixing.mix_plan(documents(spark, ["a b c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
