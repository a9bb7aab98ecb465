"""Whole jobs: read the zones of a lake, compute, write."""
