"""Readers that turn files into review tables."""
