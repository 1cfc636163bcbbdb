"""Whole-run plans and the registry of named queries."""


def load_queries():
    """Import every module that registers queries and return the registry."""
    from adjudica.plans import (  # noqa: F401
        decision_queries,
        model_queries,
        property_queries,
        registry,
        table_queries,
    )

    return registry
