"""Queries of the problems of TESTDATA.md, and their SQL where SQL can state them."""

from __future__ import annotations

import importlib

#: Modules with functions named pN_..., and in ``SQL`` their equivalents.
MODULES = ("tokens", "language", "sentences", "forms", "splitting", "scans", "packing", "leakage", "residue")


def _modules():
    for name in MODULES:
        try:
            yield importlib.import_module(f"quire.llm.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"quire.llm.{name}":
                raise


def queries() -> dict:
    found = {}
    for module in _modules():
        found |= {k: f for k, f in vars(module).items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= getattr(module, "SQL", {})
    return found
