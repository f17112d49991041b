"""Registered queries over the shared tables, each with its SQL form."""

from __future__ import annotations

from importlib import import_module

SECTIONS = (
    "sources",
    "columns",
    "joins",
    "dedup",
    "series",
    "stats",
    "windows",
    "models",
    "evaluation",
    "reports",
)


def catalog():
    """All registered queries: name -> Query."""
    out = {}
    for s in SECTIONS:
        for name, q in import_module(f"gsx.plans.{s}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = q
    return out
