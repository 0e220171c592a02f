"""Structured Streaming jobs. Every micro-batch writes to a folder named by
its batch id and overwrites it, so a replayed batch leaves one copy."""
