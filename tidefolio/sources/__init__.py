"""Scans, dimensions, streams and the mapping of the test tables."""
