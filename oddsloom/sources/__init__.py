"""Venue payloads, feeds and sinks."""
