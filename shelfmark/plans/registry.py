"""All queries over the reference's operators, and their SQL."""

from shelfmark.plans import catalogue, chunking, lifecycle, retrieval, search, streams, texts  # noqa: F401
from shelfmark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
