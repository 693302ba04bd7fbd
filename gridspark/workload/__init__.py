"""Registered queries with the SQL each must agree with."""

from .registry import REGISTRY, query


def load() -> dict:
    """Import every family and return the registry."""
    from . import (aggregates, catalogue, fusion, joins, kernels, predicates, pyramids, requests,  # noqa: F401
                   scalars, scans, streams)
    return REGISTRY
