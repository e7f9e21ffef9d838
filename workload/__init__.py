"""The registered queries: inputs derived from the driver tables, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["scoring", "comparison", "changes", "building", "versioning", "authority", "scanning"]


def registered() -> dict:
    """Name -> (query, SQL or None), over all query modules."""
    out: dict = {}
    for name in _MODULES:
        for key, value in import_module(f"workload.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"query registered twice: {key}")
            out[key] = value
    return out
