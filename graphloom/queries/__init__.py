"""Registered queries and their SQL oracles, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("records", "graph", "analysis", "texts", "retrieval", "fusion", "details", "insight", "building")


def registries() -> list:
    """The registries of all core areas."""
    return [import_module(f"graphloom.queries.{a}").R for a in AREAS]
