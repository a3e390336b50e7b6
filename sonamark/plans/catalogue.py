"""All queries of the library but those of the text operators."""

from . import ingest, relational, stored, waves  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
