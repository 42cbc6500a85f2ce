"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import closed_forms, contents, figures, filings, fixtures, responses, streams, tables  # noqa: F401  they register their queries
from .bindings import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
