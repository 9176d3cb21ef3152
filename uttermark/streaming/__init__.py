"""Incremental score tables."""
