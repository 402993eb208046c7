"""Conversion of files as they arrive."""
