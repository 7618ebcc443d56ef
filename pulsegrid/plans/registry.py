"""Every query of the library by name, and its DuckDB form where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def load() -> None:
    """Query modules add themselves on import."""
    from . import mask_queries, report_queries, segment_queries, signal_queries  # noqa: F401
