"""Queries over the star-schema test tables, one per operator, with SQL oracles."""

from workload.base import REGISTRY, load_all

__all__ = ["REGISTRY", "load_all"]
