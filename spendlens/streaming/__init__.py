"""Incremental ingest and request logs with Structured Streaming."""
from .ingest import clean_stream, ingest_stream
from .requests import accepted_requests, append_log, firsts, marked_log, request_files, statuses, track_firsts, track_status

__all__ = ["accepted_requests", "append_log", "clean_stream", "firsts", "ingest_stream", "marked_log", "request_files", "statuses",
           "track_firsts", "track_status"]
