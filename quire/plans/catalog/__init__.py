"""Registered queries, one module per operator family."""

from quire.plans.catalog import (  # noqa: F401
    gate, geo, metrics, plugins, replies, reviews, runs, series, sources, splits, streams, text,
)
