"""Summed-area tables of black pixels, and what follows from them for crops and frames."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from hashlib import md5
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from skyledger.operators import joins, raster
from skyledger.plans import labels


def rasters(seed):
    """Black pixels of frames: areas, single pixels, a full frame, a checkerboard, and stripes."""
    draw = random.Random(seed)
    out = {}
    for frame in range(6):
        spots = set()
        for _ in range(draw.randint(1, 4)):
            x, y, w, h = draw.randint(0, 60), draw.randint(0, 50), draw.randint(1, 20), draw.randint(1, 20)
            spots |= {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
        spots |= {(draw.randint(0, 70), draw.randint(0, 60)) for _ in range(5)}
        out[frame] = spots
    out[6] = {(x, y) for x in range(20) for y in range(20)}
    out[7] = {(x, y) for x in range(15) for y in range(15) if (x + y) % 2}
    out[8] = {(x, y) for x in range(0, 40, 3) for y in range(30)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_the_pixels_inside(spark, seed):
    spots = rasters(seed)
    rows = [(f, x, y) for f, s in spots.items() for x, y in s]
    table = raster.summed_areas(spark.createDataFrame(rows + rows[:50], "frame_id int, x int, y int"))
    draw, crops = random.Random(seed), []
    for f in [*spots, 99]:
        for _ in range(25):
            x0, y0 = draw.randint(-10, 80), draw.randint(-10, 70)
            crops.append((len(crops), f, (x0, y0, x0 + draw.randint(0, 40), y0 + draw.randint(0, 40))))
    df = spark.createDataFrame(crops, "id int, frame_id int, crop struct<x0:int,y0:int,x1:int,y1:int>").join(table, "frame_id", "left")
    got = {r["id"]: r["dark_pixels"] for r in df.withColumn("dark_pixels", raster.dark_pixels(F.col("crop"), F.col("dark"))).collect()}
    want = {i: sum(x0 <= x < x1 and y0 <= y < y1 for x, y in spots.get(f, ())) for i, f, (x0, y0, x1, y1) in crops}
    assert got == want


def test_a_table_is_as_small_as_its_edges(spark):
    rows = spark.range(200).select(F.lit(1).alias("frame_id"), F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(10), F.lit(109))))
    dark = raster.summed_areas(rows).first()["dark"]
    assert (dark["xs"], dark["ys"], dark["sums"]) == ([0, 200], [10, 110], [0, 0, 0, 20000])


def test_no_pixels(spark):
    assert raster.summed_areas(spark.createDataFrame([], "frame_id int, x int, y int")).count() == 0


def test_crops_over_the_limit_go(spark):
    """2 % of 64 x 64 pixels are 81.92: 81 black pixels stay, 82 go; bright pixel rows do not count."""
    pixels = [(1, k % 64, k // 64, 0, 0, 0) for k in range(81)] + [(2, k % 64, k // 64, 0, 7, 0) for k in range(82)] + [(3, k % 64, k // 64, 0, 9, 0) for k in range(500)]
    pixels = spark.createDataFrame(pixels, "image_id int, x int, y int, b08 int, b13 int, b15 int")
    images = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False)], "image_id int, readable boolean")
    frames = labels.with_images(spark.range(1, 7).select(F.col("id").cast("int").alias("image_id")), images, pixels)
    assert {r["image_id"]: r["readable"] for r in frames.collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
    placed = frames.withColumn("crop", F.struct(*[F.lit(v).alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 64), ("y1", 64))]))
    assert sorted(r["image_id"] for r in labels.covered(placed).collect()) == [1, 3, 4, 5, 6]


def test_frames_without_an_image_fail(spark):
    frames = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-01 00:10:00", 2)], "t string, image_id int").select(
        F.to_timestamp("t").alias("frame_time"), "image_id")
    none = spark.createDataFrame([], "image_id int, x int, y int, b08 int, b13 int, b15 int")
    seen = labels.with_images(frames, spark.createDataFrame([(1, True)], "image_id int, readable boolean"), none)
    strikes = spark.createDataFrame([], "ts timestamp, lat double, lon double, solution_key string")
    rows = labels.natural_labels(seen, strikes).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in rows} == {"negative": 12, "failed": 1}


def test_blocked_parts_hold_no_clear_centre_and_drop_cells(spark):
    moment = datetime(2024, 1, 1, 0, 10)
    events = [(f"s{i}", moment + timedelta(minutes=m), la, lo) for i, (m, la, lo) in enumerate([
        (0, 3.9, 101.9), (-25, 2.9, 103.9), (-20, 6.79, 104.39), (29, 1.2, 99.7), (30, 5.0, 103.0), (5, None, 102.0), (3, 3.9, 101.9)])]
    strikes = spark.createDataFrame(events, "solution_key string, ts timestamp, lat double, lon double")
    frame = spark.createDataFrame([(moment,)], "frame_time timestamp")
    blocked = labels.blocked_parts(frame, strikes).first()["blocked"]
    # the cell of (3.9, 101.9) lies whole in the box of its event; events outside of the window block nothing
    assert blocked[5 * 1000 + 4] == labels.WHOLE and 3 * 1000 + 8 not in blocked and 7 * 1000 + 6 not in blocked
    centres = [
        (moment, r, c, k, 1.2 + (r + (k // 5 + v) / 5) * 0.5, 99.7 + (c + (k % 5 + v) / 5) * 0.5)
        for r in range(11) for c in range(9) for k in range(25) for v in (0.001, 0.999) if blocked.get(r * 1000 + c, 0) >> k & 1
    ]
    df = spark.createDataFrame(centres, "frame_time timestamp, r int, c int, k int, lat double, lon double")
    assert len(centres) > 500 and joins.patch_clear(df, strikes, *labels.NEGATIVE_WINDOW).where("clear").count() == 0
    target = frame.selectExpr("frame_time", "3.9D as t_lat", "101.9D as t_lon", "false as own")
    seen = target.join(labels.blocked_parts(frame, strikes), "frame_time").select(labels._levels().alias("levels")).first()["levels"]
    assert 0 not in [x["level"] for x in seen] and len(seen) > 0


def test_draws_beside_strikes_fail_before_they_are_tested(spark, monkeypatch):
    """Picks are those of the plain loop; a frame full of strikes is not drawn for, and of one half full few draws are tested."""
    frames = [datetime(2024, 1, 1, 0, 10 * k) for k in range(4)]
    lattice = [(1.25 + 0.2 * i, 99.75 + 0.2 * j) for i in range(28) for j in range(24)]
    events = [(frames[0], *p) for p in lattice] + [(frames[1], *p) for p in lattice if p[1] < 102.2] + [(frames[2], 4.0, 102.0), (frames[2], None, 100.0)]
    strikes = spark.createDataFrame(
        [(f"s{i}", t + timedelta(minutes=i % 10), la, lo) for i, (t, la, lo) in enumerate(events)], "solution_key string, ts timestamp, lat double, lon double")
    asked = spark.createDataFrame([(t, 1) for t in frames], "frame_time timestamp, image_id int")
    none = spark.createDataFrame([], "image_id int, x int, y int, b08 int, b13 int, b15 int")
    seen = labels.with_images(asked, spark.createDataFrame([(1, True)], "image_id int, readable boolean"), none)
    tested, plain = [], joins.min_distance_filter
    monkeypatch.setattr(joins, "min_distance_filter", lambda df, *a: tested.append(df.groupBy("frame_time").count().collect()) or plain(df, *a))
    got = {(r["frame_time"], r["attempt"], r["x"], r["y"]) for r in labels.random_negatives(seen, strikes, 30, 700).collect()}

    def draw(seed, t, attempt, size):
        text = f"{seed}|{int(t.replace(tzinfo=timezone.utc).timestamp())}|{attempt}"
        return int(int(md5(text.encode()).hexdigest()[:8], 16) / 2**32 * size) + 32

    def far(t, x, y):
        lat, lon = 6.8 - y / 279 * (6.8 - 1.2), 99.7 + x / 234 * (104.4 - 99.7)
        near = [(a, b) for u, a, b in events if u == t and a is not None and abs(a - lat) < 0.3]
        return all(2 * 6371.0 * asin(sqrt(sin(radians(a - lat) / 2) ** 2 + cos(radians(a)) * cos(radians(lat)) * sin(radians(b - lon) / 2) ** 2)) >= 30 for a, b in near)

    want = set()
    for t in frames:
        places = [(t, k, draw("rnx", t, k, 171), draw("rny", t, k, 216)) for k in range(1, 701)]
        want |= set([p for p in places if far(t, *p[2:])][:30])
    assert got == want and {t for t, *_ in got} == set(frames[1:])
    rows = Counter()
    for call in tested:
        rows.update({r["frame_time"]: r["count"] for r in call})
    assert rows[frames[0]] == 0 and 30 <= rows[frames[1]] < 85
