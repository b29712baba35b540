"""The registered queries: one or more for each operator."""

from millrace.queries import aggregation, cleaning, control, listing, matching, profiling, quality, sources, streaming  # noqa: F401
from millrace.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
