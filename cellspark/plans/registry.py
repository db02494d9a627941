"""All queries of the engine's own operators, gathered from the operator modules."""

from __future__ import annotations

from . import queries_extended, queries_files, queries_geometry, queries_imaging, queries_io, queries_models, queries_stats

MODULES: tuple = (queries_geometry, queries_stats, queries_extended, queries_io, queries_imaging, queries_files, queries_models)


def queries() -> dict:
    """Query name to function of (spark, sf_dir)."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    """Query name to DuckDB SQL."""
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
