import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import negatives
from skyledger.llm.queries import ORACLE, QUERIES

ROWS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, negatives_=10):
    rows = [(i, [int(np.floor(256.0 * x)) for x in v], y) for i, v, y in rows
            if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors, out = [], []
    for row in rows:
        if row[0] is not None and row[0] % 100 == 0 and row not in anchors:
            anchors.append(row)

    def order(found):
        return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))

    for own, v, y in anchors:
        scored = [(sum(a * b for a, b in zip(v, w)), i, z) for i, w, z in rows if i != own]
        for p, pid, _ in order(r for r in scored if r[2] == y)[:positives]:
            fits = order(r for r in scored if r[2] != y and 30 * p <= 100 * r[0] <= 90 * p)[:negatives_]
            out += [(own, pid, k + 1, nid, p, n) for k, (n, nid, _) in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in ("id", "key", "part", "block", "score", "rank", "bits", "_anchor")})
    found = negatives.mine_negatives(table, F.col("vec_id") % 100 == 0, parts=3, **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def vectors(seed, count, width=19, labels=4):
    draw = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in draw.normal(0.05, 0.3, width)], int(draw.integers(labels))) for i in draw.choice(2000, count, replace=False)]


def test_equals_all_pairs(spark):
    rows = vectors(1, 300) + [(100 * k, v, y) for k, (_, v, y) in enumerate(vectors(2, 12), start=30)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, slab=16, block=3) == brute(rows)


def test_hard_rows(spark):
    """Nulls, ties, repeated rows, null ids, rows of other lengths, scores of zero and below."""
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 40, width=3, labels=2)
    rows += [(0, [1.0, 0.0, 0.0], 1), (0, [1.0, 0.0, 0.0], 1), (1, None, 1), (2, [1.0], None), (3, [nan, 1.0], 1), (4, [inf], 1), (5, [None, 1.0], 1)]
    rows += [(2001 + k, [0.5, 0.25, 0.0], k % 2) for k in range(15)] + [(2001, [0.5, 0.25, 0.0], 1), (None, [0.5, 0.25, 0.0], 0), (None, [0.5, 0.3, 0.0], 1)]
    rows += [(300, [], 1), (400, [0.0, 0.0], 0), (500, [-1.0, -0.5], 1), (600, [0.25] * 30, 0)]
    assert mined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert mined(spark, []) == []


@pytest.mark.parametrize("low,high,width", [(-700, 700, 64), (-1, 0, 5), (0, 1, 8), (-(2**40), 2**40, 9), (0, 0, 3)])
def test_lookups_are_inner_products(low, high, width):
    draw = np.random.default_rng(width)
    a, b = draw.integers(low, high + 1, (7, width)), draw.integers(-300, 300, (11, width))
    assert (negatives.scores(negatives.subset_tables(b), negatives.bit_planes(a)) == a @ b.T).all()


def test_query_equals_sql_on_a_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = QUERIES["op13_hard_negatives"](spark, sf)
    names = [d[0] for d in con.execute(ORACLE["op13_hard_negatives"]).description]
    want = sorted(con.execute(ORACLE["op13_hard_negatives"]).fetchall())
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == want
