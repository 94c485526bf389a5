"""Ten-minute grid, local time, calendar and chronological splits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_SECONDS = 600


def floor_slot(ts: Column, seconds: int = SLOT_SECONDS) -> Column:
    epoch = F.unix_seconds(ts)
    return F.timestamp_seconds(epoch - F.pmod(epoch, F.lit(seconds)))


def ceil_slot(ts: Column, seconds: int = SLOT_SECONDS) -> Column:
    micros = F.unix_micros(ts)
    step = seconds * 1_000_000
    return F.timestamp_micros(micros + F.pmod(-micros, F.lit(step)))


def plus_minutes(ts: Column, minutes) -> Column:
    shift = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.timestamp_micros(F.unix_micros(ts) + shift.cast("bigint") * F.lit(60_000_000))


def slot_number(ts: Column, seconds: int = SLOT_SECONDS) -> Column:
    epoch = F.unix_seconds(ts)
    return ((epoch - F.pmod(epoch, F.lit(seconds))) / seconds).cast("bigint")


def target_window(frame: Column, nowcast_minutes: int = 0) -> tuple[Column, Column]:
    horizon = nowcast_minutes if nowcast_minutes > 0 else 10
    return frame, plus_minutes(frame, horizon)


def satellite_id(frame: Column) -> Column:
    # fixed value: cut-over instant between the two spacecraft
    return F.when(frame >= F.lit(datetime(2022, 12, 13)).cast("timestamp"), "H09").otherwise("H08")


def frame_id(frame: Column) -> Column:
    return F.concat_ws("_", satellite_id(frame), F.date_format(frame, "yyyyMMdd_HHmm"))


def bucket(frame: Column) -> Column:
    return F.when(satellite_id(frame) == "H09", "noaa-himawari9").otherwise("noaa-himawari8")


def split_by_instant(ts: Column, train_end: str, val_end: str) -> Column:
    return (
        F.when(ts <= F.lit(train_end).cast("timestamp"), "train")
        .when(ts <= F.lit(val_end).cast("timestamp"), "val")
        .otherwise("test")
    )


def split_by_date(ts: Column, train_end: str, val_end: str) -> Column:
    day = F.to_date(ts)
    return (
        F.when(day <= F.lit(train_end).cast("date"), "train")
        .when(day <= F.lit(val_end).cast("date"), "val")
        .otherwise("test")
    )


def local_hour(ts: Column, offset: int = 8) -> Column:
    return F.pmod(F.hour(ts) + offset, F.lit(24))


def time_block(hour: Column) -> Column:
    return (
        F.when(hour < 6, "00:00-05:59")
        .when(hour < 12, "06:00-11:59")
        .when(hour < 18, "12:00-17:59")
        .otherwise("18:00-23:59")
    )


def stratum(month: Column, hour: Column) -> Column:
    return F.concat_ws("|", month.cast("string"), F.floor(hour / 4).cast("string"))


def season(month: Column) -> Column:
    return F.floor(F.pmod(month, F.lit(12)) / 3).cast("int")
