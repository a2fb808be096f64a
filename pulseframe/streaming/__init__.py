"""Streaming twins of the feature tables and of voice activity."""

from pulseframe.streaming.windows import windowed_features

__all__ = ["windowed_features"]
