"""Evaluation plans and the registered query catalogue."""
