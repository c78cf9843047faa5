"""Registered queries over the star-schema tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("structured", "text", "audit", "evaluation", "samples", "features", "modelling", "ingest")


def load() -> tuple[dict, dict]:
    from tracefold.queries import registry

    for name in _MODULES:
        import_module(f"tracefold.queries.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
