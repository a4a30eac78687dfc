"""Structured Streaming forms of the refresh and of the event rollup."""
