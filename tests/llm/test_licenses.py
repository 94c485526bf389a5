import random

from skyledger.llm import licenses
from skyledger.llm.license_texts import TEMPLATES

from .common import HARD, clashing, documents


def test_templates_are_found_in_full(spark):
    noise = " ".join(f"noise{i}" for i in range(40))
    names = sorted(TEMPLATES)
    docs = clashing(documents(spark, [f"{noise} {TEMPLATES[n].upper()} {noise}" for n in names]))
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(docs, TEMPLATES).collect()}
    for i, name in enumerate(names):
        match = [m for m in rows[i]["matches"] if m["license"] == name]
        assert match and match[0]["coverage"] == 1.0
        assert (match[0]["start"], match[0]["stop"]) == (40, 40 + len(licenses.tokens(TEMPLATES[name])))


def test_edited_template_is_aligned_and_clean_text_is_not(spark):
    words = TEMPLATES["mit"].split()
    draw = random.Random(2)
    for _ in range(8):
        words[draw.randrange(len(words))] = "changed"
    del words[30:33]
    texts = [" ".join(words), "the software is provided to the public", "licensed " * 300]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts), TEMPLATES).collect()}
    assert rows[0]["license"] == "mit" and 0.8 <= rows[0]["coverage"] < 1
    assert rows[1]["license"] is None and rows[2]["license"] is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_alignment_equals_longest_common_subsequence():
    draw = random.Random(4)
    for _ in range(60):
        template = [draw.choice("abcdefgh") for _ in range(draw.randint(5, 25))]
        text = [x for x in template if draw.random() > 0.15]
        index = licenses.Index({"t": " ".join(template)}, k=2, window=2)
        import numpy as np

        ids = np.array([index.code[x.encode()] for x in text])
        found = index.align(0, ids, [(0, 0)], slack=40)
        want = lcs([x.encode() for x in template], [x.encode() for x in text])
        assert (round(want / len(template), 6) if want else None) == (found[0] if found else None)


def test_hard_rows_and_empty_table(spark):
    docs = documents(spark, HARD + HARD)
    assert licenses.scan_licenses(docs, TEMPLATES).where("license is not null").count() == 0
    assert licenses.scan_licenses(docs, TEMPLATES).count() == 2 * len(HARD)
    assert licenses.scan_licenses(docs.where("false"), TEMPLATES).count() == 0


def test_repeated_passage_of_a_window_is_kept_in_both():
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(200):
        shared = draw.integers(0, 50, 6).astype(np.uint64)
        left = np.concatenate([draw.integers(0, 50, 9).astype(np.uint64), shared])
        right = np.concatenate([shared, draw.integers(0, 50, 9).astype(np.uint64)])
        assert {int(left[i]) for i in licenses.winnow(left, 4)} & {int(right[i]) for i in licenses.winnow(right, 4)}
