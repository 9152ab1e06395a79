"""Dialect queries over Structured Streaming inputs."""
