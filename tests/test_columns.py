from pyspark.sql import functions as F

from skyledger.functions import geo, scores, timegrid
from skyledger.operators import planning, raster


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def ts(text):
    return F.lit(text).cast("timestamp")


def test_slots(spark):
    assert str(one(spark, timegrid.floor_slot(ts("2024-01-15 00:19:46")))) == "2024-01-15 00:10:00"
    shifted = timegrid.plus_minutes(ts("2024-01-15 00:19:46"), -60)
    assert str(one(spark, timegrid.ceil_slot(shifted))) == "2024-01-14 23:20:00"


def test_object_key(spark):
    key = planning.object_key(ts("2024-01-15 00:10:00"), F.lit("B13"), F.lit(5))
    assert one(spark, key) == (
        "noaa-himawari9/AHI-L1b-FLDK/2024/01/15/0010/HS_H09_20240115_0010_B13_FLDK_R20_S0510.DAT.bz2"
    )
    assert one(spark, timegrid.satellite_id(ts("2022-12-12 23:50:00"))) == "H08"


def test_pixels_round_half_even_and_invert(spark):
    x, y = geo.to_pixel(F.lit(6.8), F.lit(99.7))
    assert (one(spark, x), one(spark, y)) == (0, 0)
    lat, lon = geo.to_lonlat(F.lit(234), F.lit(279))
    assert abs(one(spark, lat) - 1.2) < 1e-9 and abs(one(spark, lon) - 104.4) < 1e-9


def test_band_scaling(spark):
    nan, inf = float("nan"), float("inf")
    values = [(nan,), (inf,), (-inf,), (180.0,), (330.0,), (255.0,)]
    rows = spark.createDataFrame(values, "k double").select(raster.band_to_uint8(F.col("k"), "B13").alias("v")).collect()
    assert [r["v"] for r in rows] == [0, 255, 0, 0, 255, 128]
    assert one(spark, raster.finite_value(F.lit(inf))) == 255


def test_probability_bins_follow_the_edges(spark):
    import numpy as np

    values = [i / 1000 for i in range(1001)]
    got = spark.createDataFrame([(v,) for v in values], "p double").select(
        "p", scores.probability_bin(F.col("p"), 10).alias("b")
    ).collect()
    edges = np.linspace(0, 1, 11)
    for r in got:
        want = min(int(np.searchsorted(edges, r["p"], side="right")) - 1, 9)
        assert r["b"] == want, r
