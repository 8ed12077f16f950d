"""Feeds: declared schemas, landing folders, staged tables, documentation."""
