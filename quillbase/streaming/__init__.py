"""Continuous loading of tables."""

from quillbase.streaming.ingest import append_stream

__all__ = ["append_stream"]
