"""Incremental runs over a landing folder."""

from quire.streaming.incremental import process_new_files, stream_files

__all__ = ["process_new_files", "stream_files"]
