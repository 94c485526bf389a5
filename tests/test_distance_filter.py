"""Centres far from every event, in a crowd of events."""

from __future__ import annotations

import datetime as dt
import math

from skyledger.operators import joins

T = dt.datetime(2024, 1, 5, 10, 0)


def _km(a, b, c, d):
    p = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(p))


def test_crowd_is_judged_as_one_row_per_query_and_cell(spark, monkeypatch):
    """Results are those of all pairs; sub-cells of a crowd become no rows, and a settled query opens none."""
    events = [(i, T + dt.timedelta(seconds=i % 600), 3.0 + 0.011 * (i % 60), 101.0 + 0.013 * (i // 60)) for i in range(3000)]
    events += [(9000, T + dt.timedelta(seconds=600), 5.5, 103.5), (9001, T - dt.timedelta(seconds=1), 5.5, 103.5)]  # outside the window
    queries = [(T, 2.6 + 0.07 * (k % 15), 100.6 + 0.09 * (k // 15)) for k in range(180)] + [(T, 5.5, 103.5)]
    strikes = spark.createDataFrame(events, "solution_key bigint, ts timestamp, lat double, lon double")
    asked = spark.createDataFrame(queries, "frame_time timestamp, lat double, lon double")
    held = []
    plain = joins.cut

    def watched(df):
        held.append(plain(df))
        return held[-1]

    monkeypatch.setattr(joins, "cut", watched)
    got = {(r["lat"], r["lon"]) for r in joins.min_distance_filter(asked, strikes, 0, 10, 30.0).collect()}
    inside = [e for e in events if T <= e[1] < T + dt.timedelta(minutes=10)]
    want = {(a, b) for _, a, b in queries if all(_km(c, d, a, b) >= 30.0 for _, _, c, d in inside)}
    assert got == want and 0 < len(want) < len(queries)
    seen = held[0].collect()
    assert len(seen) <= 4 * len(queries) and any(r["_near"] for r in seen)
    assert all(r["_open"] is None for r in seen if r["_near"])
