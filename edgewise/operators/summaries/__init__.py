"""Mergeable summaries in plain Python, for partial results inside a task and for streaming state."""
