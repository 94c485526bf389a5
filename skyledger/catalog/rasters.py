"""Raster and patch queries over pixel rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.catalog.base import query, rr, sql_with, steady, u
from skyledger.operators import raster as R
from skyledger.sources import adapters as A

ODD = "case when (frame_id + y * 8 + x) % 31 = 0 then 'nan'::double when (frame_id + y * 8 + x) % 37 = 0 then 'infinity'::double when (frame_id + y * 8 + x) % 41 = 0 then '-infinity'::double else kelvin end"


def damaged(spark, sf):
    """Pixels with some NaN and infinities."""
    at = F.col("frame_id") + F.col("y") * 8 + F.col("x")
    k = (
        F.when(at % 31 == 0, float("nan")).when(at % 37 == 0, float("inf")).when(at % 41 == 0, float("-inf"))
        .otherwise(F.col("kelvin"))
    )
    return A.pixels(spark, sf).withColumn("kelvin", k)


def u8(band: str) -> str:
    low, high = R.RANGES_K[band]
    return f"case when isnan(k) then 0 else round_even((least(greatest(k, {low}::double), {high}::double) - {low}::double) / {high - low}::double * 255.0::double, 0) end::int"


@query("band_to_uint8", sql_with("pixels", f"+o as (select frame_id, x, y, {ODD} as k from pixels) select frame_id, x, y, {', '.join(f'{u8(b)} as {b.lower()}' for b in R.RANGES_K)} from o"))
def band_to_uint8(spark, sf):
    return damaged(spark, sf).select(
        "frame_id", "x", "y", *[R.band_to_uint8(F.col("kelvin"), b).alias(b.lower()) for b in R.RANGES_K]
    )


@query("finite_patch", sql_with("pixels", f"+o as (select frame_id, x, y, {ODD} as k from pixels) select frame_id, x, y, case when isnan(k) then 0 else trunc(least(greatest(k - 150.0::double, 0.0::double), 255.0::double)) end::int as v from o"))
def finite_patch(spark, sf):
    return damaged(spark, sf).select("frame_id", "x", "y", R.finite_value(F.col("kelvin") - 150.0).alias("v"))


BLACK = "avg((b08 < 8 and b13 < 8 and b15 < 8)::int)"


# patches 0, 67, 134, ... have no pixels here
EMPTY = f"bf as (select vec_id as frame_id, coalesce({BLACK}, 1.0::double) as black_fraction from embeddings left join (select * from pixels where frame_id % 67 <> 0) p on vec_id = p.frame_id group by vec_id)"


def _patches(spark, sf):
    pixels = A.pixels(spark, sf).where(F.col("frame_id") % 67 != 0)
    return pixels, A.patches(spark, sf).select(F.col("patch_id").alias("frame_id"))


@query("black_fraction", sql_with("pixels", f"+{EMPTY} select frame_id, {rr('black_fraction')} as black_fraction from bf"))
def black_fraction(spark, sf):
    pixels, patches = _patches(spark, sf)
    return R.black_fraction(pixels, ["frame_id"], patches=patches).withColumn("black_fraction", steady("black_fraction"))


@query("valid_coverage", sql_with("pixels", f"+{EMPTY} select frame_id, {rr('black_fraction')} as black_fraction from bf where black_fraction <= 0.02"))
def valid_coverage(spark, sf):
    pixels, patches = _patches(spark, sf)
    return R.valid_coverage(pixels, ["frame_id"], patches=patches).withColumn("black_fraction", steady("black_fraction"))


@query("patch_extract", sql_with("pixels", """+c as (select vec_id as frame_id, (vec_id % 4)::int as x0, (vec_id % 3)::int as y0 from embeddings)
select p.frame_id, p.x - c.x0 as px, p.y - c.y0 as py, b08, b13, b15 from pixels p join c on p.frame_id = c.frame_id where x >= x0 and x < x0 + 4 and y >= y0 and y < y0 + 4"""))
def patch_extract(spark, sf):
    k = F.col("patch_id")
    crops = A.patches(spark, sf).select(k.alias("frame_id"), (k % 4).cast("int").alias("x0"), (k % 3).cast("int").alias("y0"))
    crops = crops.withColumns({"x1": F.col("x0") + 4, "y1": F.col("y0") + 4})
    return R.patch_extract(A.pixels(spark, sf), crops, tile=4).select("frame_id", "px", "py", *R.BANDS)


@query("patch_tiles", """with t as (select vec_id as frame_id, x.x::int as x0, y.y::int as y0, least(x.x + 4, 8)::int as x1, least(y.y + 4, 8)::int as y1 from embeddings cross join range(0, 8, 3) x(x) cross join range(0, 8, 3) y(y))
select 'ragged' as mode, * from t union all select 'whole', * from t where x1 - x0 = 4 and y1 - y0 = 4""")
def patch_tiles(spark, sf):
    frames = A.patches(spark, sf).select(F.col("patch_id").alias("frame_id"))
    ragged = R.patch_tiles(frames, 8, 8, 4, 3, ragged=True).withColumn("mode", F.lit("ragged"))
    return ragged.unionByName(R.patch_tiles(frames, 8, 8, 4, 3).withColumn("mode", F.lit("whole")))


@query("channel_stats", sql_with("pixels", f"select frame_id, {', '.join(f'''{rr(f'avg({b})')} as mean_{b}''' for b in R.BANDS)}, min(b13) as min_b13 from pixels group by frame_id"))
def channel_stats(spark, sf):
    return R.channel_stats(A.pixels(spark, sf), ["frame_id"]).withColumns({f"mean_{b}": steady(f"mean_{b}") for b in R.BANDS})


def norm_sql(family: str) -> str:
    means, deviations = R.MEAN_STD[family]
    return ", ".join(f"{rr(f'({b} / 255.0::double - {m}::double) / {s}::double')} as {b}" for b, m, s in zip(R.BANDS, means, deviations))


@query("normalize_patch", sql_with("pixels", f"select 'small' as family, frame_id, x, y, {norm_sql('small')} from pixels union all select 'pretrained', frame_id, x, y, {norm_sql('pretrained')} from pixels"))
def normalize_patch(spark, sf):
    px = A.pixels(spark, sf)
    parts = [
        px.select(F.lit(f).alias("family"), "frame_id", "x", "y", *[steady(c).alias(b) for b, c in R.normalize(f).items()])
        for f in R.MEAN_STD
    ]
    return parts[0].unionByName(parts[1])


@query("augment_right_angle", sql_with("pixels", f"""+a as (select *, case when {u('auh', 'frame_id')} < 0.5::double then 7 - x else x end as hx, case when {u('auv', 'frame_id')} < 0.5::double then 7 - y else y end as hy, floor({u('aur', 'frame_id')} * 4)::int as k from pixels)
select frame_id, (case k when 0 then hx when 1 then hy when 2 then 7 - hx else 7 - hy end)::int as x, (case k when 0 then hy when 1 then 7 - hx when 2 then 7 - hy else hx end)::int as y, b08, b13, b15 from a"""))
def augment_right_angle(spark, sf):
    return R.augment_right_angle(A.pixels(spark, sf), 8, "au").select("frame_id", "x", "y", *R.BANDS)


def patch_manifest(spark, sf, facts):
    """Manifest rows over patches with a few planted defects."""
    rows = A.patches(spark, sf).select("patch_id", (F.col("class_id") >= 5).cast("int").alias("label")).join(
        facts.select("patch_id", "digest"), "patch_id"
    )
    k = F.col("patch_id")
    split = F.when(k % 10 < 7, "train").when(k % 10 < 8, "val").otherwise("test")
    folder = F.when((F.col("label") == 1) != (k % 29 == 0), "/positive/").otherwise("/negative/")
    where = F.when(k % 43 == 0, "other").otherwise(F.col("split"))
    return rows.withColumn("split", split).select(
        "patch_id", "label", "split", F.concat(F.lit("root/"), where, folder, k.cast("string"), F.lit(".png")).alias("path"),
        F.when(k % 47 == 0, "bad").otherwise(F.col("digest")).alias("sha"), (k % 300).cast("string").alias("crop_key"),
    )


AUDIT = """fa as (select frame_id as patch_id, count(*) as n_pixels, (count(b08) > 0)::int + (count(b13) > 0)::int + (count(b15) > 0)::int as channels, min(least(b08, b13, b15)) as low, max(greatest(b08, b13, b15)) as high, avg((b08 < 1 and b13 < 1 and b15 < 1)::int) as zero_share,
  count(*) filter (isnan(kelvin) or isinf(kelvin)) as nonfinite, md5(string_agg(b08::varchar || ',' || b13::varchar || ',' || b15::varchar, ';' order by y, x)) as digest from pd group by frame_id),
ma as (select vec_id as patch_id, (label >= 5)::int as label, case when vec_id % 10 < 7 then 'train' when vec_id % 10 < 8 then 'val' else 'test' end as split,
  case when vec_id % 47 = 0 then 'bad' else digest end as sha, (vec_id % 300)::varchar as crop_key, 'root/' || case when vec_id % 43 = 0 then 'other' when vec_id % 10 < 7 then 'train' when vec_id % 10 < 8 then 'val' else 'test' end
  || case when (label >= 5) <> (vec_id % 29 = 0) then '/positive/' else '/negative/' end || vec_id::varchar || '.png' as path from embeddings join fa on vec_id = fa.patch_id),
jo as (select ma.*, f.n_pixels, f.channels, f.low, f.high, f.zero_share, f.nonfinite, f.digest from ma left join (select * from fa where patch_id % 41 <> 0) f on ma.patch_id = f.patch_id),
au as (select count(*) filter (n_pixels is null) as missing, count(*) filter (channels <> 3) as wrong_channels, count(*) filter (n_pixels <> 64) as wrong_dimensions, count(*) filter (low = high) as constant, count(*) filter (zero_share > 0.02) as black, count(*) filter (nonfinite > 0) as nonfinite,
  count(*) filter (digest <> sha) as hash_mismatch, count(*) filter (not contains(path, '/' || split || '/')) as incorrect_split_path, count(*) filter ((label = 1) <> contains(path, '/positive/')) as incorrect_label_metadata,
  count(*) - count(distinct sha) as duplicate_file_hash, count(*) - count(distinct crop_key) as duplicate_crop from jo)"""
AUDIT = f"pd as (select frame_id, x, y, b08, b13, b15, {ODD} as kelvin from pixels where not (frame_id % 53 = 0 and x = 7)),\n{AUDIT}"


@query("patch_audit", sql_with("pixels", f"+{AUDIT} select * from au"))
def patch_audit(spark, sf):
    px = damaged(spark, sf).where(~((F.col("frame_id") % 53 == 0) & (F.col("x") == 7)))
    facts = R.patch_facts(px.withColumnRenamed("frame_id", "patch_id"), "patch_id")
    manifest = patch_manifest(spark, sf, facts)
    return R.patch_audit(manifest, facts.where(F.col("patch_id") % 41 != 0), 64)


@query("black_scan", sql_with("pixels", f"""+b as (select frame_id, (any_value(class_id) >= 5)::int as label, {BLACK} as f from pixels group by frame_id)
select label, count(*) as count, {rr('avg(f)')} as mean, {rr('max(f)')} as maximum, count(*) filter (f > 0.02) as gt_02pct, count(*) filter (f > 0.3) as gt_30pct, count(*) filter (f > 0.5) as gt_50pct,
  count(*) filter (f = 1) as exact_100pct, {rr('quantile_cont(f, 0.5)')} as median from b group by label"""))
def black_scan(spark, sf):
    rows = R.black_fraction(A.pixels(spark, sf).withColumn("label", (F.col("class_id") >= 5).cast("int")), ["frame_id", "label"])
    return R.black_scan(rows).withColumns({c: steady(c) for c in ("mean", "maximum", "median")})
