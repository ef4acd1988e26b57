"""Whole jobs: pyramids and written files."""
