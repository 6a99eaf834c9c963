"""Named queries over the carrier tables, with the SQL that must give the same rows."""

from __future__ import annotations

from fogline.queries import decisions, fields, ingest, labelling, operations, products, records, serving, state, verification  # noqa: F401  they register their queries
from fogline.queries._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
