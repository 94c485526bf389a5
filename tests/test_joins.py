import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skyledger.operators import joins

BASE = datetime(2024, 1, 1)


def at(minutes):
    return BASE + timedelta(minutes=minutes)


def strikes(spark, rows):
    return spark.createDataFrame(
        [(at(m), float(la), float(lo), f"k{i}") for i, (m, la, lo) in enumerate(rows)],
        "ts timestamp, lat double, lon double, solution_key string",
    )


def frames(spark, minutes):
    return spark.createDataFrame([(at(m),) for m in minutes], "frame_time timestamp")


def test_window_ends(spark):
    events = strikes(spark, [(60, 1, 100), (61, 1, 100), (70, 1, 100), (71, 1, 100)])
    closed = joins.window_join(frames(spark, [60]), events, 0, 10)
    assert sorted(r.ts for r in closed.collect()) == [at(60), at(61)]
    nowcast = joins.window_join(frames(spark, [60]), events, 0, 10, left_open=True)
    assert sorted(r.ts for r in nowcast.collect()) == [at(61), at(70)]


def test_patch_clear_small_cases(spark):
    events = strikes(spark, [(5, 3.0, 101.0), (25, 4.0, 102.0)])
    centres = spark.createDataFrame(
        [("in", at(0), 3.0, 101.0), ("far", at(0), 6.0, 104.0), ("late", at(0), 4.0, 102.0)],
        "candidate_id string, frame_time timestamp, lat double, lon double",
    )
    got = {r.candidate_id: r for r in joins.patch_clear(centres, events, 0, 10, 0.0).collect()}
    assert not got["in"].clear and got["far"].clear and got["late"].clear
    got = {r.candidate_id: r for r in joins.patch_clear(centres, events, -20, 25, 0.0).collect()}
    assert got["late"].clear  # the window end is exclusive
    got = {r.candidate_id: r for r in joins.patch_clear(centres, events, -20, 30, 0.0).collect()}
    assert not got["late"].clear


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b - d) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_box_counts_and_nearest_against_brute_force(spark):
    random.seed(3)
    rows = []
    for i in range(1500):  # a third of the events crowd one spot and one slot
        if i % 3 == 0:
            rows.append((30 + random.random() * 9.9, 3.0 + random.random() * 0.8, 101.0 + random.random() * 0.8))
        else:
            rows.append((random.random() * 120, 1.2 + random.random() * 5.6, 99.7 + random.random() * 4.7))
    rows += rows[:50]  # exact copies
    events = strikes(spark, rows)
    centres = [(f"c{i}", random.randrange(0, 120), 1.5 + random.random() * 5, 100 + random.random() * 4) for i in range(120)]
    df = spark.createDataFrame(
        [(n, at(m), la, lo) for n, m, la, lo in centres], "candidate_id string, frame_time timestamp, lat double, lon double"
    )
    clear = {r.candidate_id: r for r in joins.patch_clear(df, events, -7, 13, 10.0).collect()}
    near = {r.candidate_id: r for r in joins.nearest_strike(df, events, -7, 13).collect()}
    for n, m, la, lo in centres:
        window = [(t, a, o) for t, a, o in rows if m - 7 <= t < m + 13]
        dlat = 0.64 + 10 / 111.32
        dlon = 0.64 + 10 / (111.32 * max(math.cos(math.radians(la)), 0.1))
        inside = sum(abs(a - la) <= dlat and abs(o - lo) <= dlon for _, a, o in window)
        assert clear[n].inside_count == inside and clear[n].clear == (inside == 0)
        best = min((km(a, o, la, lo) for _, a, o in window), default=None)
        got = near[n].nearest_distance_km
        assert (best is None and got is None) or abs(best - got) < 1e-6


def test_label_exists(spark):
    events = strikes(spark, [(0, 2.0, 100.0), (0, 4.9, 100.0)])
    patches = spark.createDataFrame([(v,) for v in (1.5, 1.51, 2.49, 2.5, 3.0, 4.41, 5.39, 5.4)], "lat double")
    got = {r.lat: r.label for r in joins.label_exists(patches, events).collect()}
    assert got == {v: int(abs(v - 2.0) < 0.5 or abs(v - 4.9) < 0.5) for v in got}


def test_nearest_sends_only_kept_cells(spark):
    # one query and 48 cells with an event each: one or two cells may hold the nearest
    events = strikes(spark, [(5, 0.3 + 0.75 * a, 0.3 + 0.75 * o) for a in range(6) for o in range(8)])
    df = spark.createDataFrame([("c", at(0), 0.31, 0.31)], "candidate_id string, frame_time timestamp, lat double, lon double")
    asked = joins.with_query(df, -20, 30, 0.0)
    found = joins.nearest(asked, events)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # no query meets all cells as rows
    assert abs(found.first().nearest_distance_km - km(0.3, 0.3, 0.31, 0.31)) < 1e-6


def test_nearest_is_found_around_most_queries(spark, monkeypatch):
    """Results are those of all pairs; only queries far from all events, beside a crowd or over the date line search the whole window."""
    rng = random.Random(8)
    even = [(rng.uniform(-5, 15), rng.uniform(2, 4), rng.uniform(100, 102)) for _ in range(300)]
    crowd = [(rng.uniform(0, 10), 5 + rng.uniform(0, 0.004), 103 + rng.uniform(0, 0.004)) for _ in range(90)]
    copies = [(m, la, lo) for _, la, lo in even[:20] for m in (9, 1, 4)]
    later = [(125, -20.0, -179.9), (126, -20.5, 179.5), (131, 85.0, 10.0)]
    events = even + crowd + copies + later
    asked = [(0, rng.uniform(2, 4), rng.uniform(100, 102)) for _ in range(150)] + [(0, 5.002, 103.002), (0, 2.5, 108.0), (120, -20.0, 179.95), (120, 89.0, -170.0)]
    queries = asked + [(0, la, lo) for _, la, lo in copies[:6]] + asked[:3]
    df = spark.createDataFrame([(f"c{i}", at(m), la, lo) for i, (m, la, lo) in enumerate(queries)] + [("none", at(0), None, 101.0)],
                               "candidate_id string, frame_time timestamp, lat double, lon double")
    searched, plain = [], joins._nearest_of_all
    monkeypatch.setattr(joins, "_nearest_of_all", lambda left, *a: searched.append(left.count()) or plain(left, *a))
    blank = spark.createDataFrame([(None, 3.0, 101.0), (at(5), None, 101.0), (at(5), 3.0, None)], "ts timestamp, lat double, lon double")
    got = {r.candidate_id: r for r in joins.nearest_strike(df, strikes(spark, events).drop("solution_key").unionByName(blank), 0, 10).collect()}
    for i, (m, la, lo) in enumerate(queries):
        want = min((km(la, lo, a, b), t - m) for t, a, b in events if m <= t < m + 10)
        assert got[f"c{i}"].nearest_distance_km == pytest.approx(want[0], abs=1e-6)
        assert got[f"c{i}"].nearest_minutes == pytest.approx(want[1], abs=1e-4)
    assert got["none"].nearest_distance_km is None and len(got) == len(queries) + 1
    assert searched and searched[0] < 40


AUDITED = [("near", 0, 10, 10.0), ("wide", -20, 30, 10.0), ("shifted", -7, 13, 0.0), ("again", 0, 10, 10.0)]


def test_contamination_audit_is_plain_counting(spark):
    rng = random.Random(5)
    places = [(rng.randrange(0, 80, 10), rng.uniform(1, 4), rng.uniform(100, 103)) for _ in range(150)]
    events = [(rng.uniform(-30, 110), rng.choice([1.5, rng.uniform(1, 4)]), rng.uniform(100, 103)) for _ in range(60)]
    events += events[:9]
    negatives = spark.createDataFrame(
        [(at(m), la, lo) for m, la, lo in [*places, *places[:5]]] + [(None, 2.0, 101.0), (at(0), None, 101.0), (at(0), 2.0, None)],
        "frame_time timestamp, lat double, lon double",
    )
    blank = spark.createDataFrame([(None, 2.0, 101.0), (at(5), None, 101.0), (at(5), 2.0, None)], "ts timestamp, lat double, lon double")
    strong = strikes(spark, events).drop("solution_key").unionByName(blank)

    def hit(m, la, lo, a, b, margin):
        dlat = 0.64 + margin / 111.32
        dlon = 0.64 + margin / (111.32 * max(math.cos(math.radians(la)), 0.1))
        return any(m + a <= t < m + b and abs(y - la) <= dlat and abs(x - lo) <= dlon for t, y, x in events)

    got = {r["window"]: (r.negatives, r.contaminated) for r in joins.contamination_audit(negatives, strong, AUDITED).collect()}
    assert got == {n: (158, sum(hit(*p, a, b, m) for p in [*places, *places[:5]])) for n, a, b, m in AUDITED}
    assert 0 < got["near"][1] < got["wide"][1] < 155


def test_whole_cells_settle_places(spark):
    """Places in a crowd need no single events: a whole cell of the bin lies in their box."""
    rng = random.Random(6)
    crowd = strikes(spark, [(rng.uniform(0, 10), rng.uniform(1.51, 2.24), rng.uniform(100.51, 101.24)) for _ in range(400)])
    cells = joins._cells(joins._points(crowd)).drop("subs", "n")
    places = spark.createDataFrame([(at(0), 1.9, 100.9), (at(0), 3.5, 100.9), (at(30), 1.9, 100.9)], "frame_time timestamp, lat double, lon double")
    rows = {(r.frame_time, r.lat): r.sure for r in joins.surely_hit(places, cells, AUDITED).collect()}
    assert rows == {(at(0), 1.9): [True] * 4, (at(0), 3.5): [False] * 4, (at(30), 1.9): [False, False, False, False]}
