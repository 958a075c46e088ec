"""Readers, catalog merges, exports and report sinks."""
