"""Registry of named queries with their reference SQL, and the shared SQL prelude."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and ISO date strings, the same in every engine and time zone."""
    target = {T.TimestampType: "timestamp_ntz", T.DateType: "string"}
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(target[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in target else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def steady(c, digits=6):
    """Round with a tiny shift, so exact decimal ties do not depend on summation order."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 10.0 ** -(digits + 3), digits)


def rounded(df, names, digits=6):
    return df.withColumns({n: steady(n, digits) for n in names})


def rr(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + 1e-{digits + 3}::double, {digits})"


def r(names, digits: int = 6) -> str:
    return ", ".join(f"{rr(n, digits)} as {n}" for n in names)


def u(seed: str, *keys: str) -> str:
    """SQL text of a uniform draw."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8))::bigint / 4294967296.0::double)"


def md5(seed: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def hav(a: str, b: str, c: str, d: str, radius: float = 6371.0088) -> str:
    dp, dl = f"radians(({a}) - ({c})) / 2", f"radians(({b}) - ({d})) / 2"
    return (
        f"({2 * radius}::double * asin(sqrt(least(sin({dp}) * sin({dp}) + cos(radians({a})) * cos(radians({c}))"
        f" * sin({dl}) * sin({dl}), 1.0::double))))"
    )


def split_sql(ts: str) -> str:
    return (
        f"case when {ts} <= timestamp '2024-01-21 23:59:59' then 'train' "
        f"when {ts} <= timestamp '2024-01-25 23:59:59' then 'val' else 'test' end"
    )


CTE: dict[str, str] = {
    "manifest": f"""manifest as (select *, x - 32 as x0, y - 32 as y0, x + 32 as x1, y + 32 as y1,
  md5(concat_ws('|', 'sha', (x // 3)::varchar, (y // 3)::varchar)) as sha256 from (select 'p' || solution_key as path, (kind = 'Ground')::int as label, ts, slot as frame_time,
  'H09_' || strftime(slot, '%Y%m%d_%H%M') as frame_id, strftime(slot, '%Y-%m-%d') as date,
  source_file || '_' || strftime(slot, '%Y%m%d') as storm_id, 'hsd_' || strftime(slot, '%Y%m%d_%H') || ';aux_' || source_file as source_files,
  case when {u('fc', "strftime(slot, '%Y%m%d_%H%M')")} < 0.6::double then 'active' else 'zero_recorded' end as frame_category,
  case when {u('nz', 'solution_key')} < 0.002::double then 'test' else {split_sql('slot')} end as split, lat, lon, amplitude,
  round_even((lon - 99.7::double) / (104.4::double - 99.7::double) * 234, 0)::int as x, round_even((6.8::double - lat) / (6.8::double - 1.2::double) * 279, 0)::int as y,
  floor((lat - 1.2::double) / 0.5::double)::bigint::varchar || '_' || floor((lon - 99.7::double) / 0.5::double)::bigint::varchar as grid_cell,
  least(lat - 1.2::double, 6.8::double - lat, lon - 99.7::double, 104.4::double - lon) * 111.0::double as boundary_km,
  ((hour(slot) + 8) % 24)::int as local_hour, month(slot)::int as month
  from (select *, time_bucket(interval '10 minutes', ts) as slot from strikes)))""",
    "strikes": """strikes as (select cast(event_id as varchar) as solution_key, ts::timestamp as ts,
  1.2::double + ((user_id*53 + event_id*29) % 560) / 100.0::double as lat,
  99.7::double + ((user_id*37 + event_id*13) % 470) / 100.0::double as lon,
  (value - 50.0::double) / 5.0::double as amplitude,
  case when event_type in ('click','view') then 'Ground' else 'Cloud' end as kind,
  'f' || (user_id % 10)::varchar as source_file, event_type from events)""",
    "ground": """ground as (select *, time_bucket(interval '10 minutes', ts) as slot from strikes where kind = 'Ground'
  and lat between 1.2::double and 6.8::double and lon between 99.7::double and 104.4::double)""",
    "candidates": """candidates as (select solution_key as candidate_id,
  time_bucket(interval '10 minutes', ts) as frame_time, lat, lon from strikes where event_type = 'error')""",
    "summary": """summary as (select slot, count(*) as n, avg(lat) as clat, avg(lon) as clon from ground group by slot)""",
    "calendar": """calendar as (select unnest(generate_series(d, d + interval '23 hours 50 minutes',
  interval '10 minutes')) as slot from (select distinct date_trunc('day', ts)::timestamp as d from strikes))""",
    "ledger": """ledger as (select c.slot, coalesce(s.n, 0)::bigint as in_mask_count,
  case when s.n > 0 then 'active' else 'zero_recorded' end as category, s.clat, s.clon
  from calendar c left join summary s on c.slot = s.slot)""",
    "predictions": f"""predictions as (select *, floor(1000.0::double * (0.6::double * {u('p', 'path')} + 0.4::double * label)) / 1000.0::double as probability
  from (select concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) as path,
  (l_returnflag = 'R')::int as label, l_linestatus as run_name, l_shipdate::date as date, l_orderkey as frame_id,
  l_suppkey as storm_id, case when l_quantity > 25 then 'active' else 'zero_recorded' end as frame_category,
  case when {u('s', 'l_orderkey')} < 0.7::double then 'train' when {u('s', 'l_orderkey')} < 0.85::double then 'val' else 'test' end as split
  from lineitem))""",
    "scored": """scored as (select *, ln(least(greatest(probability, 0.001::double), 0.999::double)
  / (1.0::double - least(greatest(probability, 0.001::double), 0.999::double))) as logit from predictions)""",
    "runs": f"""runs as (select o_orderkey as run_id, o_orderstatus as architecture, o_custkey % 3 as seed,
  o_orderpriority as loss_name, case when o_custkey % 2 = 0 then 'none' else 'right_angle' end as augmentation,
  floor({u('pr', 'o_orderkey')} * 1000) / 1000.0::double as validation_pr_auc,
  floor({u('ls', 'o_orderkey')} * 1000) / 1000.0::double as validation_loss,
  floor({u('ro', 'o_orderkey')} * 1000) / 1000.0::double as validation_roc_auc from orders)""",
    "history": f"""history as (select o_custkey as run_id, o_orderkey as step,
  row_number() over (partition by o_custkey order by o_orderkey) as epoch,
  floor({u('hp', 'o_orderkey')} * 100) / 100.0::double as pr_auc,
  floor({u('hl', 'o_orderkey')} * 100) / 100.0::double as loss from orders)""",
    "pixels0": """pixels0 as (select vec_id as frame_id, label as class_id, (i - 1) as pos,
  255.0::double + 60.0::double * embedding[i]::double as kelvin
  from (select vec_id, label, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings))""",
    "pixels": """pixels as (select frame_id, class_id, x, y, kelvin,
  case when dark then 0 else (byte * 1 + x * 17 + y * 20) % 256 end as b08,
  case when dark then 0 else (byte * 3 + x * 13 + y * 16) % 256 end as b13,
  case when dark then 0 else (byte * 5 + x * 11 + y * 14) % 256 end as b15
  from (select frame_id, class_id, (pos % 8)::int as x, (pos // 8)::int as y, kelvin,
  (frame_id % 3 = 0 and pos % 8 < 2) as dark,
  least(greatest(round_even((kelvin - 200.0::double) / 110.0::double * 255.0::double, 0), 0), 255)::int as byte from pixels0))""",
}


_NEEDS = {
    "ground": ("strikes",), "manifest": ("strikes",), "candidates": ("strikes",), "summary": ("ground",), "calendar": ("strikes",),
    "ledger": ("calendar", "summary"), "scored": ("predictions",), "pixels": ("pixels0",),
}


def sql_with(names: str, body: str, recursive: bool = False) -> str:
    """``with`` the named shared CTEs (and what they need) in front of ``body``.

    ``body`` may start with further CTEs, ending in a plain select.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    head = "with recursive " if recursive else "with "
    text = body.strip()
    joiner = ",\n" if text.startswith("+") else "\n"
    return head + ",\n".join(CTE[n] for n in ordered) + joiner + text.lstrip("+").strip()
