"""Table readers."""

from plateworks.sources.tables import table

__all__ = ["table"]
