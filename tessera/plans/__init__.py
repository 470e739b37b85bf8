"""Registered queries and their SQL."""

from __future__ import annotations


def load():
    """The registry, with all query modules loaded."""
    from tessera.plans import formats, ledger, registry, relational, structures, texts  # noqa: F401

    return registry
