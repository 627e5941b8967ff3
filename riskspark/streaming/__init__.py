"""Structured Streaming operators."""

from .scoring import Running, batch_writer, run_stream, run_stream_to_tables, scoring_transform

__all__ = ["Running", "batch_writer", "run_stream", "run_stream_to_tables", "scoring_transform"]
