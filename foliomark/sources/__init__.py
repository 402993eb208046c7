"""Corpus listing and document sinks."""
