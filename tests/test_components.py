import random
from datetime import timedelta

from pyspark.sql import functions as F

from skyledger.operators import components
from tests.test_joins import BASE, km


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_long_chain_and_hub(spark):
    random.seed(9)
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    noise = [(random.randrange(2000, 2200), random.randrange(2000, 2200)) for _ in range(90)]
    edges, nodes = chain + hub + noise, list(range(201)) + list(range(1000, 1300)) + list(range(2000, 2200))
    got = components.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "id bigint"), spark.createDataFrame(edges, "a bigint, b bigint")
    ).collect()
    assert {r["id"]: r["component"] for r in got} == roots(nodes, edges)


def test_frame_clusters_against_brute_force(spark):
    random.seed(10)
    points = []
    for frame in ("p", "q"):
        points += [(frame, 2 + random.random() * 3, 100 + random.random() * 3) for _ in range(70)]
        points += [(frame, 3 + random.random() * 0.05, 101 + random.random() * 0.05) for _ in range(150)]  # crowded cell
        points += [(frame, 3.2 + random.random() * 0.05, 101 + random.random() * 0.05) for _ in range(150)]
    df = spark.createDataFrame(points, "f string, lat double, lon double")
    labels = components.frame_clusters(df, "f").select("frame", "component").distinct().groupBy("frame").count().collect()
    got = {r["frame"]: r["count"] for r in labels}
    for frame in ("p", "q"):
        mine = [(a, o) for f, a, o in points if f == frame]
        edges = [
            (i, j) for i in range(len(mine)) for j in range(i)
            if km(*mine[i], *mine[j]) * 6371.0 / 6371.0088 <= 20
        ]
        assert got[frame] == len(set(roots(range(len(mine)), edges).values()))


def test_storm_groups_never_cross_a_split(spark):
    rows = [(BASE + timedelta(minutes=10 * i), 3.0 + 0.1 * (i % 3), 101.0) for i in range(0, 60)]
    rows += [(BASE + timedelta(days=3, minutes=10 * i), 5.0, 103.0) for i in range(3)]
    df = spark.createDataFrame(rows, "frame_time timestamp, centroid_lat double, centroid_lon double").withColumn("category", F.lit("active"))
    out = components.storm_ledger(df, "2024-01-01 05:00:00", "2024-01-02 00:00:00").collect()
    assert {r.storm_id for r in out} == {"DERIVED_STORM_000000", "DERIVED_STORM_000001"}
    assert {(r.storm_id, r.split) for r in out} == {("DERIVED_STORM_000000", "val"), ("DERIVED_STORM_000001", "test")}
