"""Structured Streaming versions of the incremental steps. The batch tool this follows has no streams; these are additions."""
