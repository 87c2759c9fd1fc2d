"""Structured Streaming: deduplication, stateful snapshots, sinks."""
