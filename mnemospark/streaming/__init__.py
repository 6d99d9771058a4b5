"""Structured Streaming: resumable logs, incremental stores and windows."""
