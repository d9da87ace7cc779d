"""Exports and table writes."""
