"""Great-circle distance, pixel maps, crops and grid cells as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088
RADIUS_KM_V1 = 6371.0
KM_PER_DEGREE = 111.32


@dataclass(frozen=True)
class Mask:
    """A latitude/longitude study area with its pixel shape."""

    lat_min: float = 1.2
    lat_max: float = 6.8
    lon_min: float = 99.7
    lon_max: float = 104.4
    height: int = 280
    width: int = 235

    def contains(self, lat: Column, lon: Column) -> Column:
        return lat.between(self.lat_min, self.lat_max) & lon.between(self.lon_min, self.lon_max)


MASK = Mask()


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM) -> Column:
    dp = F.radians(lat1 - lat2) / 2
    dl = F.radians(lon1 - lon2) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl) * F.sin(dl)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _gap(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - value, value - high, F.lit(0.0))


def box_distance_bounds(
    lat: Column, lon: Column, lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column, radius: float = RADIUS_KM
) -> tuple[Column, Column]:
    """Lower and upper bound (km) of the distance from a point to any point of a box.

    Both collapse to the exact distance when the box is a single point.
    """

    def hav(dlat: Column, dlon: Column, coslat: Column) -> Column:
        dp, dl = F.radians(dlat) / 2, F.radians(dlon) / 2
        a = F.sin(dp) * F.sin(dp) + F.cos(F.radians(lat)) * coslat * F.sin(dl) * F.sin(dl)
        return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))

    cos_a, cos_b = F.cos(F.radians(lat_lo)), F.cos(F.radians(lat_hi))
    far_cos = F.when((lat_lo <= 0) & (lat_hi >= 0), F.lit(1.0)).otherwise(F.greatest(cos_a, cos_b))
    lower = hav(_gap(lat, lat_lo, lat_hi), _gap(lon, lon_lo, lon_hi), F.least(cos_a, cos_b))
    upper = hav(
        F.greatest(F.abs(lat - lat_lo), F.abs(lat - lat_hi)),
        F.greatest(F.abs(lon - lon_lo), F.abs(lon - lon_hi)),
        far_cos,
    )
    return lower, upper


def to_pixel(lat: Column, lon: Column, mask: Mask = MASK) -> tuple[Column, Column]:
    x = F.rint((lon - mask.lon_min) / (mask.lon_max - mask.lon_min) * (mask.width - 1))
    y = F.rint((F.lit(mask.lat_max) - lat) / (mask.lat_max - mask.lat_min) * (mask.height - 1))
    return x.cast("int"), y.cast("int")


def to_lonlat(x: Column, y: Column, mask: Mask = MASK) -> tuple[Column, Column]:
    lat = F.lit(mask.lat_max) - y / (mask.height - 1) * (mask.lat_max - mask.lat_min)
    lon = F.lit(mask.lon_min) + x / (mask.width - 1) * (mask.lon_max - mask.lon_min)
    return lat, lon


def crop(x: Column, y: Column, size: int = 64) -> Column:
    half = size // 2
    return F.struct(
        (x - half).alias("x0"), (y - half).alias("y0"),
        (x - half + size).alias("x1"), (y - half + size).alias("y1"),
    )


def crop_inside(bounds: Column, mask: Mask = MASK) -> Column:
    return (
        (bounds["x0"] >= 0) & (bounds["y0"] >= 0)
        & (bounds["x1"] <= mask.width) & (bounds["y1"] <= mask.height)
    )


def box_half_degrees(lat: Column, size: int, degrees_per_pixel: float, margin_km: Column) -> tuple[Column, Column]:
    """Half height and half width (degrees) of a patch box widened by a margin."""
    half = size * degrees_per_pixel / 2
    dlat = F.lit(half) + margin_km / KM_PER_DEGREE
    dlon = F.lit(half) + margin_km / (F.lit(KM_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(0.1)))
    return dlat, dlon


def boundary_distance_km(lat: Column, lon: Column, mask: Mask = MASK) -> Column:
    return F.least(lat - mask.lat_min, F.lit(mask.lat_max) - lat, lon - mask.lon_min, F.lit(mask.lon_max) - lon) * 111.0


def cell_index(value: Column, low: float, high: float, step: float) -> Column:
    count = int((high - low) // step)
    return F.least(F.greatest(F.floor((value - low) / step), F.lit(0)), F.lit(count - 1)).cast("int")


def cell_centre(index: Column, low: float, step: float) -> Column:
    return F.lit(low) + (index + 0.5) * step


def grid_label(lat: Column, lon: Column, mask: Mask = MASK, step: float = 0.5) -> Column:
    return F.concat_ws(
        "_",
        F.floor((lat - mask.lat_min) / step).cast("string"),
        F.floor((lon - mask.lon_min) / step).cast("string"),
    )
