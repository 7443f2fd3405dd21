"""Whole jobs composed from sources, operators and sinks."""
