"""All registered queries."""

from __future__ import annotations

from gazette.registry import digests, histories, ingest, people  # noqa: F401
from gazette.registry.base import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
