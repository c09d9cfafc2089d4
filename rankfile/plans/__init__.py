"""Every query of the core, and its SQL."""

from __future__ import annotations


def _registries() -> list:
    from ..operators import metrics, movetext, positions
    from ..streaming import ingest
    from . import evaluation_ops, ingest_ops, layout_ops, more_ops, quality_ops, relational_ops, scalar_ops, search_ops, text_ops, tree_ops
    from .registry import Registry

    extra = Registry()
    for name, f in (*positions.QUERIES.items(), *metrics.QUERIES.items(), *movetext.QUERIES.items()):
        extra.plan(name, f)
    for name, (f, sql) in ingest.QUERIES.items():
        extra.plan(name, f, sql)
    return [m.R for m in (scalar_ops, relational_ops, more_ops, search_ops, evaluation_ops, quality_ops, ingest_ops, tree_ops, layout_ops, text_ops)] + [extra]


def all_queries() -> dict:
    return {k: f for r in _registries() for k, f in r.queries.items()}


def all_sql() -> dict[str, str]:
    return {k: t for r in _registries() for k, t in r.sql.items()}
