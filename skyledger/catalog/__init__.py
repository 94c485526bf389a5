"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ingest", "columns", "pairing", "verify", "clusters", "picks", "labelling", "rasters", "audits", "learned", "live")


def load():
    from skyledger.catalog import base

    for name in MODULES:
        import_module(f"skyledger.catalog.{name}")
    return base.QUERIES, base.ORACLE
