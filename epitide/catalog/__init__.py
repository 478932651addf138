"""Registered queries: each capability run over the given tables, with its SQL equivalent."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalars", "storage", "combining", "summarising", "sequencing", "assembling", "reporting", "modelling")


def all_queries() -> list:
    return [q for name in MODULES for q in import_module(f"epitide.catalog.{name}").Q.items]
