"""Incremental loading of session files."""

from .growing import ingest_growing_sessions
from .ingest import broken_chunks, ingest_files, ingest_sessions

__all__ = ["broken_chunks", "ingest_files", "ingest_growing_sessions", "ingest_sessions"]
