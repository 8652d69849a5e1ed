"""Queries over the given tables, one or more per operator."""


def load():
    """Import every query module; return (queries, sql)."""
    from ticklake.plans import (  # noqa: F401
        q_aggregates,
        q_functions,
        q_joins,
        q_metrics,
        q_reads,
        q_sinks,
        q_sources,
        q_streaming,
        q_versions,
        q_windows,
        registry,
    )

    return registry.QUERIES, registry.SQL
