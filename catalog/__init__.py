"""Every operator and analysis as a runnable query with its SQL twin."""

from catalog.registry import REGISTRY

from catalog import aggregates, analyses, depth, domain, joins, models, relational, scalars, sources, stratified, texts  # noqa: F401

__all__ = ["REGISTRY"]
