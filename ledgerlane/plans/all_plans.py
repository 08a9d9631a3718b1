"""Imports every module that registers queries."""

from ledgerlane.plans import custody_queries, reconcile_queries, scope_queries, source_queries  # noqa: F401
