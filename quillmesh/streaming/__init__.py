"""Structured Streaming: debounced reindexing, incremental merges, snapshot diffs."""
