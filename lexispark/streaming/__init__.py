"""Streams: what sessions have seen, sessions that end, event lines."""
