"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import confusables, language, leakage, mixing, names, near_duplicates, prose, scans, truncation

_MODULES = (prose, scans, near_duplicates, confusables, names, language, leakage, mixing, truncation)


def queries() -> dict:
    """Every function p<N>_... of the modules, by name."""
    return {name: getattr(m, name) for m in _MODULES for name in sorted(vars(m)) if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= getattr(m, "SQL", {})
    return out
