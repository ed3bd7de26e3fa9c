"""Optional incremental forms; the reference has no streams."""

from plateworks.streaming.ingest import ingest_new

__all__ = ["ingest_new"]
