"""Streaming jobs: each runs once over what is new, or keeps running."""
