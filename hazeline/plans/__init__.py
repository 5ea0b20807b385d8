"""Registered queries: each applies an operator to a whole view."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("ingest", "normalise", "units", "align", "series", "splits", "verify", "resample", "audit")


def load() -> None:
    for name in GROUPS:
        import_module(f"hazeline.plans.{name}")
