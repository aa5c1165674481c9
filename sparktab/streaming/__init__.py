"""Continuous scoring of arriving files."""
