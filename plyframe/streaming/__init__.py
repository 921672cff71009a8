"""Structured Streaming: the progress protocol and incremental page processing."""
