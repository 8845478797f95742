"""Registered queries. Importing this package fills the registry."""

from tallyframe.plans import (  # noqa: F401
    aggregates,
    clusters,
    expressions,
    filters,
    joins,
    quality,
    sales,
    statistics,
    storage,
    suggestions,
)
