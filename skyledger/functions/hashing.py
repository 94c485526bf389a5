"""Hash-ordered randomness: reproducible on any cluster and in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed: str, parts: tuple) -> Column:
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]).cast("binary"))


def hash_order(seed: str, *parts) -> Column:
    """A pseudo-random sort key."""
    return _key(seed, parts)


def uniform(seed: str, *parts) -> Column:
    """A uniform number in [0,1) from the first 32 bits of the digest."""
    return F.conv(F.substring(_key(seed, parts), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
