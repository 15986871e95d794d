"""Queries of the library over the given tables, with SQL that checks them."""

from workload import context, diffs, files, findings, indexes, outputs, reports, reviews, trees  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
