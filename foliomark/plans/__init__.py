"""Whole conversions and the registered queries."""
