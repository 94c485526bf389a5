"""The frozen frame plan: picks under a recorded protocol, and the guard of its content."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from skyledger.operators import planning, selection
from skyledger.session import cut
from skyledger.sources import files


@dataclass(frozen=True)
class Protocol:
    """What a plan depends on besides its rows; ``quotas`` maps a split to (active, empty) frames."""

    quotas: dict[str, tuple[int, int]]
    seed: str = "plan"
    least_retained: int = 1
    rule_version: str = "rule-2"
    number: int = 42
    phase: str = "full"

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def pick_active(rows: DataFrame, protocol: Protocol) -> DataFrame:
    """Quota-many active frames by diversity, with their order of picking in their split."""
    want = {s: q[0] for s, q in protocol.quotas.items()}
    able = rows.where("category = 'active'").where(rows["retained"] >= protocol.least_retained)
    pool = cut(selection.active_pool(able, want, f"{protocol.seed}a"))
    return selection.picked_rows(pool, selection.select_active(pool, want))


def pick_zero(rows: DataFrame, active: DataFrame, protocol: Protocol) -> DataFrame:
    """Quota-many empty frames, matched to the mix of the picked active ones."""
    want = {s: q[1] for s, q in protocol.quotas.items()}
    pool = cut(selection.zero_pool(rows.where("category <> 'active'"), want, f"{protocol.seed}z"))
    return selection.picked_rows(pool, selection.select_zero(pool, want, selection.active_mix(active)))


def frozen_plan(rows: DataFrame, protocol: Protocol) -> DataFrame:
    """Both picks with the protocol's stamps.

    ``rows`` is the ledger with ``split, category, storm_id, date, month, local_time_block,
    cached, retained``; other columns, such as removal counts, stay.
    """
    rows = cut(rows)
    active = cut(pick_active(rows, protocol))
    both = active.unionByName(pick_zero(rows, active, protocol)).drop("random")
    return planning.version_stamp(both, protocol.digest(), protocol.rule_version, protocol.number, protocol.phase)


def plan_digest(plan: DataFrame) -> str:
    """A digest of the plan's rows that does not depend on their order or partitions."""
    row = files.fingerprint(plan).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def require_frozen(plan: DataFrame, protocol: Protocol, digest: str) -> DataFrame:
    """The plan, if it was made under ``protocol`` and its rows are still those of ``digest``; else an error."""
    other = plan.where(plan["configuration_hash"] != protocol.digest()).limit(1).count()
    if other:
        raise ValueError("the plan was frozen under another protocol")
    if plan_digest(plan) != digest:
        raise ValueError("the frozen plan has changed")
    return plan
